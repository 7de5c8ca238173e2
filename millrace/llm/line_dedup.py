"""Cross-site boilerplate lines by distinct-site spread. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Keys up to which a table of lines is sent to every task: 5 MB at most. A larger one is joined by shuffle.
SENT_KEYS = 200_000
#: Into so many parts the occurrences of each line are dealt then.
SALTS = 32

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 4
#: log2 of a sketch's buckets; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within this share of the threshold are counted exactly (about nine standard errors).
BAND = 0.3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _line_key(line: Column) -> Column:
    """96 bits of hash of a line without outer blanks; null for an empty one."""
    bare = _bare(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def occurrences(docs: DataFrame, site: str = "source") -> DataFrame:
    """(a, b, site, doc_id, text_key, pos): every line that is not blank, by its key."""
    keys = F.transform(_lines(F.col("text")), _line_key)
    rows = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.posexplode(keys).alias("pos", "k"))
    return rows.filter("k is not null").select("k.a", "k.b", "site", "doc_id", "text_key", "pos")


def _on_lines(occ: DataFrame, keys: DataFrame, sent_keys: int = SENT_KEYS) -> DataFrame:
    """The occurrences whose line is in ``keys``(a, b, ...), with its further columns; ``keys`` is durable, so counting it is cheap.

    A few keys are broadcast, which leaves every occurrence where it is. Else both sides are shuffled by line and a salt of the occurrence,
    so that a line of any frequency is dealt to SALTS tasks.
    """
    if keys.count() <= sent_keys:
        return occ.join(F.broadcast(keys), ["a", "b"])
    salt = F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.lit(SALTS))
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return occ.withColumn("salt", salt).join(salted, ["a", "b", "salt"]).drop("salt")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", band: float = BAND, sent_keys: int = SENT_KEYS) -> DataFrame:
    """(a, b, first): keys of the lines on at least ``min_sites`` distinct sites, and their first occurrence (doc_id, pos).

    One HyperLogLog sketch of sites per line merges by aggregation, partial sketches before the shuffle, so that a line of any
    frequency reaches a reducer as one sketch from each map task. Lines whose estimate is within ``band`` of the threshold are
    counted exactly: their (line, site) pairs are combined in the map tasks and then shuffled by the pair, so a hot line sends one row from each
    map task and site. Null sites count as one site.
    """
    occ = occurrences(docs, site)
    spread = occ.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"))
    wide = durable(spread.filter(F.col("sites") >= min_sites * (1 - band)))
    sure = wide.filter(F.col("sites") > min_sites * (1 + band))
    near = wide.filter(F.col("sites") <= min_sites * (1 + band))
    pairs = _on_lines(occ, near.select("a", "b"), sent_keys).groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    return sure.select("a", "b", "first").unionByName(near.join(exact, ["a", "b"]).select("a", "b", "first"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", keep_first: bool = True, sent_keys: int = SENT_KEYS) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of ``text``; all columns stay.

    The first occurrence of each boilerplate line (least doc_id, then position; null ids first) stays, so content that is copied
    across sites survives once; ``keep_first=False`` removes it too. Blank lines stay. Null texts stay null, empty ones empty;
    a text may become empty. Repeated rows lose the same lines. Texts are shuffled once at most, by id and text hash.
    """
    bad = durable(boilerplate(docs, min_sites, site, sent_keys=sent_keys))
    hits = _on_lines(occurrences(docs, site), bad, sent_keys)
    if keep_first:
        hits = hits.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("pos").alias("_gone"))
    same = docs["doc_id"].cast("long").eqNullSafe(per["_id"]) & (F.xxhash64(docs["text"]) == per["_key"])
    lines = _lines(docs["text"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), per["_gone"])
    text = F.when(per["_gone"].isNull(), docs["text"]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return docs.join(per, same, "left").select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines left and characters of the cleaned text, with its digest."""
    got = clean(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return got.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("lines_left"), F.length(text).cast("long").alias("chars_left"), F.md5(text.cast("binary")).alias("text_md5"))


ORACLE = f"""
with l as (
  select doc_id, coalesce(source, '') as site, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), k as (select *, trim(line, ' ' || chr(9) || chr(13)) as bare from l),
b as (
  select bare, min(struct_pack(d := doc_id, p := pos)) as first from k where bare <> '' group by bare having count(distinct site) >= {MIN_SITES}
), j as (
  select k.doc_id, k.pos, k.line from k left join b using (bare) where b.bare is null or (k.doc_id = b.first.d and k.pos = b.first.p)
), r as (select doc_id, string_agg(line, chr(10) order by pos) as text, count(*) as n from j group by doc_id)
select d.doc_id, coalesce(r.n, 1)::bigint as lines_left, length(coalesce(r.text, ''))::bigint as chars_left, md5(coalesce(r.text, '')) as text_md5
from documents d left join r on d.doc_id = r.doc_id
"""
