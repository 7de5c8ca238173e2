"""Merkle manifest of a corpus: a root over all sources, an inclusion proof of every document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions, table

#: Children of a node, and the levels that are collapsed in one array: a block has ARITY ** LEVELS nodes at most.
ARITY, LEVELS = 16, 2
#: (group, range) counts up to which they are sent to all tasks.
SENT_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def _div(a: Column, b: int | Column) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a document: each field as its UTF-8 byte count, a colon and the value, or a dash if null."""
    return digest(_field(doc_id.cast("long")), _field(source), _field(lang), _field(n_chars.cast("long")), _field(text))


def numbered(rows: DataFrame, group: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with pos, from 0, of each row in its group by ``order``, and n, the rows of the group.

    Rows are dealt by ranges of (group, order), equal ones at random, so a group of any size is spread over many tasks; each range
    counts its rows of a group, and running sums over those counts, of which a group has no more than there are ranges, give the places.
    """
    n = partitions or shuffle_partitions(rows.sparkSession)
    ranged = rows.withColumn("_tie", F.rand(1)).repartitionByRange(n, group, *order, "_tie").sortWithinPartitions(group, *order).drop("_tie")
    dealt = durable(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    counts = dealt.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_r")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_r")) - F.col("_n")
    places = durable(counts.select("_group", "_r", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("_group")).alias("n")))
    near = F.broadcast(places) if places.count() <= SENT_ROWS else places
    return dealt.join(near, (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_r"))).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_group", "_r", "_shift")


def _up(nodes: Column) -> Column:
    """The digests of every ARITY nodes in turn, the last of fewer."""
    runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, ARITY).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.aggregate(F.slice(nodes, r * ARITY + 1, F.lit(ARITY)), F.lit(""), lambda a, x: F.concat(a, x)), 256))


def _depth(n: Column) -> Column:
    """Levels of a block above its own nodes: none over a lone node, LEVELS in a tree of as many as a block holds or more."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def _steps(depth: Column) -> Column:
    return F.slice(F.array(*[F.lit(k) for k in range(1, LEVELS + 1)]), F.lit(1), depth)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, n, members, levels, top) of nodes(tree, pos, n, digest, extra): arrays of ARITY ** LEVELS nodes, collapsed in place."""
    member = F.struct("pos", "digest", "extra")
    block = _div(F.col("pos"), ARITY**LEVELS).alias("block")
    sorted_ = nodes.groupBy("tree", block, "n").agg(F.array_sort(F.collect_list(member)).alias("members"))
    own = F.transform("members", lambda m: m["digest"])
    levels = F.aggregate(_steps(_depth(F.col("n"))), F.array(own), lambda a, _: F.concat(a, F.array(_up(F.element_at(a, -1)))))
    return sorted_.withColumn("levels", levels).withColumn("top", F.get(F.element_at("levels", -1), F.lit(0)))


def _path(levels: Column, i: Column) -> Column:
    """The siblings of member i of a block, level by level: those left of it and those right of it, each as one string."""

    def step(k: Column) -> Column:
        below = F.element_at(levels, k)
        at = _div(i, F.element_at(F.array(*[F.lit(ARITY**j) for j in range(LEVELS)]), k)).cast("int")
        first = _div(at, ARITY).cast("int") * ARITY
        left, right = F.slice(below, first + 1, at - first), F.slice(below, at + 2, first + ARITY - 1 - at)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(_steps(F.size(levels) - 1), step)


def _forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all levels, from the nodes up, and (tree, top) of every tree.

    Each round groups the block roots of the trees that have several by their own blocks, until every tree has one: the rounds grow
    with the logarithm of the largest tree, the driver learns its size only.
    """
    whole = ARITY**LEVELS
    tables, tops = [], []
    most = nodes.agg(F.max("n")).first()[0]
    while most is not None:
        blocks = durable(_blocks(nodes))
        tables.append(blocks)
        tops.append(blocks.filter(F.col("n") <= whole).select("tree", "top"))
        if most <= whole:
            break
        up = lambda x: _div(F.col("n") + whole - 1, whole) if x == "n" else F.col(x)
        nodes = blocks.filter(F.col("n") > whole).select("tree", F.col("block").alias("pos"), up("n").alias("n"), F.col("top").alias("digest"), F.lit(None).cast(nodes.schema["extra"].dataType).alias("extra"))
        most = -(-most // whole)
    if not tops:
        return [], nodes.select("tree", F.col("digest").alias("top"))
    out = tops[0]
    for x in tops[1:]:
        out = out.unionByName(x)
    return tables, out


def _proofs(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, top, pos, digest, extra, path) of every node of the first of ``tables``; above(tree, top, path) is what each whole tree hangs on.

    From the last table down: the path of a block's root goes on that of each of its members. Blocks meet paths by (tree, block).
    """
    whole, ups, got = ARITY**LEVELS, None, None
    for blocks in reversed(tables):
        ended = blocks.filter(F.col("n") <= whole).select(F.col("tree").alias("_tree")).join(above, F.col("_tree") == F.col("tree")).select("tree", F.lit(0).cast("long").alias("_block"), F.col("top").alias("tree_top"), F.col("path").alias("up"))
        ups = ended if ups is None else ended.unionByName(ups)
        joined = blocks.drop("top").withColumnRenamed("tree", "_tree").join(ups, (F.col("_tree") == F.col("tree")) & (F.col("block") == F.col("_block")))
        each = joined.select("tree", "tree_top", "levels", "up", F.posexplode("members").alias("i", "m"))
        got = each.select("tree", F.col("tree_top").alias("top"), "m.pos", "m.digest", "m.extra", F.concat(_path(F.col("levels"), F.col("i")), F.col("up")).alias("path"))
        ups = durable(got.select("tree", F.col("pos").alias("_block"), F.col("top").alias("tree_top"), F.col("path").alias("up"))) if blocks is not tables[0] else None
    return got


def manifest(leaves: DataFrame) -> DataFrame:
    """The Merkle tree over leaves(source, doc_id, leaf, extra): one row per leaf with its proof.

    Per source, leaves ascend by doc_id (null first), those of the same id by digest; equal leaves are interchangeable. While several
    nodes remain, every ARITY consecutive ones become their digest. Sources ascend by code point, null first, and their roots are joined
    likewise. Returns (source, doc_id, leaf, extra, subroot, root, path): path lists, from the leaf up to the root, the digests of
    the siblings left and right. ``fold`` recomputes a root from it. extra, of any type, is passed through. No leaves: no rows.

    Leaves are numbered within ranges, grouped in blocks of ARITY ** LEVELS, and a block collapses inside its row; then the roots of
    blocks are the nodes of the next round. So a source of any size is spread over many tasks, and no task holds more than blocks.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first
    nodes = numbered(leaves.withColumn("tree", key), "tree", ["doc_id", "leaf"])
    nodes = nodes.select("tree", "pos", "n", F.col("leaf").alias("digest"), F.struct("source", "doc_id", F.col("extra").alias("more")).alias("extra"))
    tables, subroots = _forest(nodes)
    tree = durable(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "top"))
    ordered = numbered(tree, "tree", ["name"]).select("tree", "pos", "n", F.col("top").alias("digest"), F.struct("name").alias("extra"))
    high, root = _forest(ordered)
    if not tables:
        return nodes.select("extra.source", "extra.doc_id", F.col("digest").alias("leaf"), F.col("extra.more").alias("extra"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    name = root.first()["top"]  # a single digest
    above = _proofs(high, root.select("tree", "top", F.array().cast(PATH).alias("path"))).select(F.col("extra.name").alias("tree"), F.col("digest").alias("top"), "path")
    got = _proofs(tables, durable(above))
    return got.select("extra.source", "extra.doc_id", F.col("digest").alias("leaf"), F.col("extra.more").alias("extra"), F.col("top").alias("subroot"), F.lit(name).alias("root"), "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["left"], h, p["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right; of nothing if there are none."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def check(docs: DataFrame, found: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the manifest of ``docs``, checked against texts ``found`` later.

    ``found`` is the text seen at the time of the check, null if it is null. A document is verified if its leaf as found, with the
    original siblings, folds to the root. docs needs FIELDS; other columns are ignored, and all but doc_id and n_chars count as strings. Null
    values have a form of their own in the leaf; repeated rows are leaves each. An empty table gives no rows.
    """
    doc_id, *others = (F.col(c) for c in FIELDS)
    rows = docs.select(F.col("source").cast("string").alias("source"), doc_id.cast("long").alias("doc_id"), leaf(doc_id, *others).alias("leaf"), F.when(F.col("text").eqNullSafe(found), None).otherwise(leaf(doc_id, *others[:-1], found)).alias("extra"))
    got = manifest(rows)
    folded = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("extra", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return check(table(spark, sf_dir, "documents"), F.when(crc % 5 == 0, low).otherwise(F.col("text")))


ORACLE = """
with recursive bytes as (select doc_id as i, list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint) as b from (select distinct doc_id from documents where doc_id is not null)),
crc as (select i, xor(list_reduce(b, lambda c, x: list_reduce(range(8), lambda y, k: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end, xor(c, x)), 4294967295::bigint), 4294967295::bigint) as crc from bytes),
d as (select documents.*, case when crc % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as seen from documents left join crc on i = doc_id),
f as (
  select doc_id, source, text, seen,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head from d
),
l as (select doc_id, coalesce('=' || source, '') as tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) as claim from f),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from l),
t(tree, lvl, idx, digest, n) as (
  select tree, 0, pos, leaf, n from placed
  union all
  select tree, lvl + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 15) // 16 from t where n > 1 group by tree, lvl, idx // 16
),
s as (select tree, lvl as depth, digest as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from t where n = 1),
u(lvl, idx, digest, n) as (
  select 0, pos, subroot, n from s
  union all
  select lvl + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 15) // 16 from u where n > 1 group by lvl, idx // 16
),
steps as (
  select p.tree, p.pos, t.lvl, coalesce(string_agg(t.digest, '' order by t.idx) filter (t.idx < p.pos // (16 ** t.lvl)::bigint), '') as lft, coalesce(string_agg(t.digest, '' order by t.idx) filter (t.idx > p.pos // (16 ** t.lvl)::bigint), '') as rgt
  from placed p join t on t.tree = p.tree and t.n > 1 and t.idx // 16 = p.pos // (16 ** (t.lvl + 1))::bigint group by p.tree, p.pos, t.lvl
  union all
  select p.tree, p.pos, s.depth + u.lvl, coalesce(string_agg(u.digest, '' order by u.idx) filter (u.idx < s.pos // (16 ** u.lvl)::bigint), ''), coalesce(string_agg(u.digest, '' order by u.idx) filter (u.idx > s.pos // (16 ** u.lvl)::bigint), '')
  from placed p join s on s.tree = p.tree join u on u.n > 1 and u.idx // 16 = s.pos // (16 ** (u.lvl + 1))::bigint group by p.tree, p.pos, s.depth, u.lvl
),
folded as (
  select tree, pos, 0 as lvl, claim as h from placed
  union all
  select f.tree, f.pos, f.lvl + 1, sha256(lft || h || rgt) from folded f join steps on (steps.tree, steps.pos, steps.lvl) = (f.tree, f.pos, f.lvl)
),
proofs as (select tree, pos, sha256(string_agg(lft || rgt, '' order by lvl)) as proof from steps group by all),
ends as (select tree, pos, arg_max(h, lvl) as folded_root from folded group by all)
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from placed join s using (tree) cross join (select digest as root from u where n = 1) join ends on (ends.tree, ends.pos) = (placed.tree, placed.pos) left join proofs on (proofs.tree, proofs.pos) = (placed.tree, placed.pos)
"""
