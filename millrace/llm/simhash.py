"""SimHash near-duplicate detection with multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, durable, shuffle_partitions, small_batches, spread_join, table
from .components import components

ASCII_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Largest number of members of a segment bucket that one task compares at once; larger buckets are dealt out by pairs of blocks.
BLOCK = 2048
#: Pairs that are compared at once.
SLICE = 1 << 16
M64 = (1 << 64) - 1


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words of single-spaced UTF-8; fewer words: of the whole; none: empty."""
    if not data:
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    ends.append(len(data))
    n = max(1, len(ends) - width + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[width - 1 :] if len(ends) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def mixed_word(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word derived from hashes (0: the hashes themselves), by the splitmix64 finaliser."""
    if not k:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) & M64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray, words: int = 1) -> list[int]:
    """Fingerprint words: a bit is set if it is in over half of the hashes."""
    n, out = len(h), []
    for k in range(words):
        if not n:
            out.append(0)
            continue
        bits = np.zeros(64, np.int64)
        for at in range(0, n, 4096):  # bounded memory for long texts
            part = mixed_word(h[at : at + 4096], k)
            bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(bits * 2 > n, bitorder="little").tobytes(), "little"))
    return out


def normalised(text: str | None) -> bytes:
    """A-Z lower-cased, words joined by one space."""
    return " ".join(WORD_RE.findall((text or "").translate(ASCII_LOWER) if not (text or "").isascii() else (text or "").lower())).encode("utf-8", "surrogatepass")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, plan: tuple[tuple[int, int], ...] = ((3, 1),)) -> DataFrame:
    """(doc_id, raw_key, text_key, w0, w1, ...): fingerprint words as signed longs; ``plan`` lists (shingle width, number of words).

    raw_key is a hash of the text as it is, text_key the XXH64 of the normalised text. Null texts count as empty: all words zero.
    Whole texts are hashed.
    """
    small_batches(docs.sparkSession)
    total = sum(n for _, n in plan)
    schema = "doc_id long, raw_key long, text_key long, " + ", ".join(f"w{i} long" for i in range(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(total + 1)]
            for text in batch.column(1):
                data = normalised(text.as_py())
                cols[0].append(_signed(xxhash.xxh64_intdigest(data)))
                words = [w for width, n in plan for w in majority(shingle_hashes(data, width), n)]
                for c, w in zip(cols[1:], words, strict=True):
                    c.append(_signed(w))
            names = ["doc_id", "raw_key", "text_key", *(f"w{i}" for i in range(total))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("raw_key")).mapInArrow(run, schema)


def _ball_keys(words: list[str], segments: list[tuple[int, int, int, int]]) -> F.Column:
    """An array of (key, probe): for each segment (word, shift, width, radius) its value, and, at radius 1, the value with each
    zero bit set. Two values one bit apart meet, as just one of them has a zero there. Probes look keys up; only key rows that
    are no probes stand in the table."""
    out = []
    for s, (w, shift, width, radius) in enumerate(segments):
        value = F.shiftrightunsigned(F.col(words[w]), shift).bitwiseAND(F.lit((1 << width) - 1))
        key = lambda v, s=s: v + F.lit(s << 33)
        out.append(F.array(F.struct(key(value).alias("key"), F.lit(False).alias("probe"))))
        if radius:
            flips = F.array(*[F.when(value.bitwiseAND(F.lit(1 << b)) == 0, F.struct(key(value.bitwiseOR(F.lit(1 << b))).alias("key"), F.lit(True).alias("probe"))) for b in range(width)])
            out.append(F.filter(flips, lambda x: x.isNotNull()))
    return F.concat(*out)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _compare(key: np.ndarray, probe: np.ndarray, node: np.ndarray, words: list[np.ndarray], most: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (key, probe): every row against the table rows of its key, by complete distances.

    Links of one call are reduced to a spanning forest. Every row meets the first table row of its key first, so that a family of
    alike rows is joined by linear work; a key whose rows are then all joined is done. The other pairs are taken in slices of
    SLICE, without those that are joined already.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(key)]))
    first = start[group]
    own = np.arange(len(key)) - first  # table rows come first: a table row looks at earlier ones, a probe at all
    has = np.where(probe, np.add.reduceat(~probe, start)[group], own)
    ids, place = np.unique(node, return_inverse=True)
    root = np.arange(len(ids))  # of each node, always the last one: paths have no second step
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        apart = root[place[a]] != root[place[b]]
        a, b = a[apart], b[apart]
        for which, limit in most:
            d = np.zeros(len(a), np.int64)
            for w in which:
                d += _popcount(words[w][a] ^ words[w][b])
            a, b = a[d <= limit], b[d <= limit]
        if not len(a):
            return
        p, q = root[place[a]], root[place[b]]
        _, one = np.unique(np.minimum(p, q) * len(ids) + np.maximum(p, q), return_index=True)
        over = root.tolist() if len(one) > len(root) // 8 else root
        kept = []
        for i in one.tolist():
            x, y = int(p[i]), int(q[i])
            while over[x] != x:
                x = int(over[x])
            while over[y] != y:
                y = int(over[y])
            if x != y:
                over[max(x, y)] = min(x, y)
                kept.append(i)
        root = np.asarray(over)
        while ((onward := root[root]) != root).any():
            root = onward
        us.append(node[a[kept]])
        vs.append(node[b[kept]])

    rows = np.flatnonzero(has > 0)
    for at in range(0, len(rows), SLICE):
        meet(rows[at : at + SLICE], first[rows[at : at + SLICE]])
    mine = root[place]
    has[(np.minimum.reduceat(mine, start) == np.maximum.reduceat(mine, start))[group]] = 0
    total = np.cumsum(has)
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        n = has[at:stop]
        if n.sum():
            meet(np.repeat(np.arange(at, stop), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n))
        at = stop
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def _deal(classes: DataFrame, segments: list[tuple[int, int, int, int]], block: int) -> DataFrame:
    """(node, words, key, probe, part): the rows that meet, grouped by (key, part), as ``hamming_links`` says."""
    words = [c for c in classes.columns if c != "node"]
    balls = _ball_keys(words, segments)
    keyed = classes.select("node", *words, F.explode(balls).alias("k")).select("node", *words, "k.key", "k.probe")
    # buckets of over ``block`` table rows: at most rows / block of each segment
    large = classes.select(F.explode(F.filter(balls, lambda k: ~k["probe"])["key"]).alias("key")).groupBy("key").count().filter(F.col("count") > block)
    large = durable(large)
    if large.isEmpty():  # then no key has more probes than ``block`` times the bits of its segment
        return keyed.withColumn("part", F.lit(0).cast("long"))
    # a large bucket probes every value that has one more bit
    segment, widest = F.shiftright("key", 33), max(width for _, _, width, _ in segments)
    probing = [(b, [s for s, (_, _, width, radius) in enumerate(segments) if radius and b < width]) for b in range(widest)]
    up = F.array(*[F.when(segment.isin(among) & (F.col("key").bitwiseAND(F.lit(1 << b)) == 0), F.col("key") + F.lit(1 << b)) for b, among in probing if among] or [F.lit(None).cast("long")])
    incoming = large.select(F.explode(up).alias("key"), "count").filter("key is not null").groupBy("key").agg(F.sum("count").alias("incoming"))
    blocks = F.greatest(F.lit(1), F.when(F.col("count") > block, F.ceil(F.col("count") / max(1, block // 2)))).cast("long")
    probes = F.when(segment.isin([s for s, x in enumerate(segments) if x[3]]), F.greatest(F.lit(1), F.ceil(F.col("incoming") / (4 * block)))).otherwise(F.lit(0)).cast("long")
    hot = durable(large.join(incoming, "key", "full").select("key", blocks.alias("blocks"), probes.alias("probes")))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    own, asks = (F.when(F.col(n) > 0, F.pmod(F.xxhash64("node"), F.col(n))) for n in ("blocks", "probes"))
    pairs = F.transform(upto("blocks"), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    asked = F.transform(upto("probes"), lambda i: -(i * F.col("blocks") + own) - 1)
    asking = F.transform(upto("blocks"), lambda j: -(asks * F.col("blocks") + j) - 1)
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("probe"), asking).otherwise(F.concat(F.array_distinct(pairs), asked))
    return keyed.join(hot, "key", "left").select("node", *words, "key", "probe", F.explode(parts).alias("part"))


def hamming_links(classes: DataFrame, segments: list[tuple[int, int, int, int]], most: list[tuple[list[int], int]], block: int = BLOCK) -> DataFrame:
    """Links (u, v) between rows of classes(node long, w0 long, ...) whose complete distances are within ``most``.

    most: (word numbers, largest distance over those words), all of which must hold. Segments have 32 bits at most. Each row stands
    in the table under the value of each segment and probes the Hamming ball around it. Rows meet by a shuffle on the segment value.
    A bucket of over ``block`` table rows is cut into blocks by hash, and every pair of its blocks meets in a group of its own.
    The probes of a value whose neighbours include such buckets are cut into blocks of about 4 * ``block`` as well, each of which
    meets each table block. So no task holds a group that grows with the data, and no comparison is lost. Of each group a
    spanning forest of the links comes back, not all pairs: components are the same.
    """
    if any(width > 32 for _, _, width, _ in segments):
        raise ValueError("segments have 32 bits at most")
    spark = classes.sparkSession
    words = [c for c in classes.columns if c != "node"]
    ready = _deal(classes, segments, block).repartition(shuffle_partitions(spark), "key", "part").sortWithinPartitions("key", "part", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def changes(cols: list[np.ndarray]) -> np.ndarray:
            return (cols[-3][1:] != cols[-3][:-1]) | (cols[-1][1:] != cols[-1][:-1])

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            node, *ws, _, probe, _ = cols
            u, v = _compare(np.cumsum(np.r_[False, changes(cols)]), probe, node, [w.view(np.uint64) for w in ws], most)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < 200_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            ends = np.flatnonzero(changes(cols))
            if not len(ends):
                held = [cols]
                continue
            cut = int(ends[-1]) + 1
            yield flush([c[:cut] for c in cols])
            held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if held:
            yield flush([np.concatenate(x) for x in zip(*held, strict=True)])

    return ready.select("node", *words, "key", "probe", "part").mapInArrow(run, "u long, v long")


#: 32-bit halves: two fingerprints at 2 or fewer differing bits differ in at most one bit of the low half, or not at all in the high one.
HALVES = [(0, 0, 32, 1), (0, 32, 32, 0)]


def link_components(fp: DataFrame, segments: list[tuple[int, int, int, int]], most: list[tuple[list[int], int]]) -> DataFrame:
    """(_node, root, component_id, rows) for fp(doc_id, w0): the component of each fingerprint, its least doc_id, and the rows of the fingerprint.

    Nulls among doc_id are passed over; a component of null ids alone has a null component_id.
    """
    classes = durable(fp.groupBy("w0").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")))
    roots = components(hamming_links(classes.select(F.col("w0").alias("node"), "w0"), segments, most))
    return named_classes(classes.select(F.col("w0").alias("_node"), "least_id", "rows"), roots)


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """classes(_node, ...) with root, by roots(node, root); a class without a link is its own root."""
    return classes.join(roots, classes["_node"] == roots["node"], "left").withColumn("root", F.coalesce("root", "_node")).drop("node")


def named_classes(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """classes(_node, least_id, ...) with root and component_id."""
    joined = durable(_rooted(classes, roots))
    ids = joined.groupBy(F.col("root").alias("_root")).agg(F.min("least_id").alias("component_id"), F.count("*").alias("_classes"))
    return spread_join(joined, ids, "root", "_root", "_classes", joined.count()).drop("_root", "_classes", "least_id")


def simhash_components(docs: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit SimHash over 3-word shingles, linked at ``distance`` (0 to 2) or fewer bits.

    Needs doc_id and text; further columns are ignored. Null and wordless texts have fingerprint zero and are linked like any
    other. Repeated rows each give a row. Rows of null doc_id are in components but are never their name, unless alone: null.
    Rows of a fingerprint that a great share of all rows has stay where they are when components are told to them.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the segments cover distances up to 2")
    fp = durable(fingerprints(docs))
    named = durable(link_components(fp, HALVES, [([0], distance)]))
    out = spread_join(fp, named, "w0", "_node", "rows", fp.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: The near-duplicate stage: words of a shingle, minima in a band, largest share of pairs at the threshold that share no band.
NEAR_WIDTH, BAND_ROWS, MISSED = 5, 6, 1e-6
#: Blocks of a large candidate group hold about so many texts and shingles.
NEAR_TEXTS, NEAR_SHINGLES = 512, 1 << 18
#: Texts of a large candidate group, on average, that all its blocks are compared with first.
PIVOTS = 8


def band_count(similarity: float) -> int:
    """Bands of BAND_ROWS minima, so that texts of that similarity share none with probability MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log1p(-min(similarity**BAND_ROWS, 1 - 1e-9)))


def _bands(h: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """A key of each band: XXH64 of the band's number and its least products of the distinct hashes; multipliers is (bands, BAND_ROWS)."""
    flat = multipliers.ravel()
    least = np.full(len(flat), M64, np.uint64)
    for at in range(0, len(h), 2048):  # bounded memory for long texts
        np.minimum(least, (flat[:, None] * h[None, at : at + 2048]).min(1), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(multipliers.shape))), np.uint64, len(multipliers)).view(np.int64)


def _near_keys(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, raw_key, text_key, w0, bands): keys as in ``fingerprints``, a fingerprint of the distinct 5-word shingles, and their bands.

    A text without words has fingerprint 0 and no bands.
    """
    small_batches(docs.sparkSession)
    multipliers = np.random.default_rng(5).integers(0, 1 << 64, (band_count(similarity), BAND_ROWS), np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, bands = [], [], []
            for text in batch.column(1):
                data = normalised(text.as_py())
                h = np.unique(shingle_hashes(data, NEAR_WIDTH))
                keys.append(_signed(xxhash.xxh64_intdigest(data)))
                words.append(_signed(majority(h)[0]))
                bands.append(_bands(h, multipliers) if data else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(words, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "raw_key", "text_key", "w0", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("raw_key")).mapInArrow(run, "doc_id long, raw_key long, text_key long, w0 long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, group, shingles) of texts(node, group, text): the distinct hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(normalised(t.as_py()), NEAR_WIDTH)).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "group", "shingles"])

    return texts.select("node", "group", "text").mapInArrow(run, "node long, group long, shingles array<long>")


def _alike(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose exact Jaccard similarity is ``similarity`` or more."""
    n = np.array([len(s) for s in sets], np.int64)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), n)
    shared = count > 1  # others add to sizes only
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    own, column = own[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, 4_000_000 // len(sets))  # bounded memory
    for at in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (at, at + step))
        part = np.zeros((len(sets), int(column[hi - 1]) - at + 1), np.float32)
        part[own[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    both = np.rint(common)
    linked = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9
    left, us, vs = np.ones(len(sets), bool), [], []
    for s in range(len(sets)):
        if not left[s]:
            continue
        left[s], front = False, np.array([s])
        while len(front):  # the next ring of texts that are linked to those reached
            hits = linked[front] & left
            new = np.flatnonzero(hits.any(0))
            us.append(node[front[hits[:, new].argmax(0)]] if len(new) else node[:0])
            vs.append(node[new])
            left[new], front = False, new
    return np.concatenate(us), np.concatenate(vs)


def _compared(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) within each (group, part) of dealt(group, part, node, shingles)."""
    ready = dealt.repartition(shuffle_partitions(dealt.sparkSession), "group", "part").sortWithinPartitions("group", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, held = None, [], []

        def flush() -> pa.RecordBatch:
            u, v = _alike(np.array(nodes, np.int64), held, similarity) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for group, part, node, values in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if now != (group, part):
                    yield flush()
                    now, nodes, held = (group, part), [], []
                nodes.append(node)
                held.append(values.values.to_numpy())
        yield flush()

    return ready.select("group", "part", "node", "shingles").mapInArrow(run, "u long, v long")


def jaccard_links(sets: DataFrame, similarity: float, texts: int = NEAR_TEXTS, shingles: int = NEAR_SHINGLES) -> DataFrame:
    """Links (u, v) among sets(node, group, shingles) of one group each whose exact Jaccard similarity is ``similarity`` or more.

    Groups of over ``texts`` rows or ``shingles`` shingles are cut into blocks by hash, so no task holds a group that grows with the
    data. Each block is compared within, and with a few pivots of its group: so a family of alike texts is joined by work in
    proportion to its size. Rows that do not belong to the largest family found so are then compared with all rows of their
    group, every pair of blocks in a part of its own. Of each part a spanning forest comes back: components are the same.
    """
    zero, upto = F.lit(0).cast("long"), lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    cut = lambda n, s: F.greatest(F.ceil(n / texts), F.ceil(s / shingles)).cast("long")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    sets = durable(sets)
    total = sets.count()
    sizes = sets.groupBy(F.col("group").alias("_group")).agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("s")).withColumn("blocks", cut(F.col("n"), F.col("s")))
    hot = durable(sizes.filter("blocks > 1"))
    if hot.isEmpty():
        return _compared(sets.withColumn("part", zero), similarity)
    placed = spread_join(sets, hot, "group", "_group", "n", total, "left")
    pivot = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < PIVOTS
    parts = F.when(F.col("blocks").isNull(), F.array(zero)).when(pivot, upto("blocks")).otherwise(F.array(own("blocks")))
    near = durable(_compared(placed.select("group", F.explode(parts).alias("part"), "node", "shingles"), similarity))
    family = components(near).select(F.col("node").alias("_node"), F.col("root").alias("family"))
    large = placed.filter("blocks is not null").select("group", "node", F.size("shingles").cast("long").alias("size"))
    large = durable(large.join(family, large["node"] == F.col("_node"), "left").select("group", "node", "size", F.coalesce("family", "node").alias("family")))
    per = large.groupBy("group", "family").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    most = per.groupBy(F.col("group").alias("_group")).agg(F.max(F.struct("n", "family", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = most.select("_group", "n", F.col("top.family").alias("top"), cut(F.col("top.n"), F.col("top.s")).alias("a"), cut(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("b"))
    open_ = durable(most.filter("b > 0"))
    if open_.isEmpty():
        return near
    i, j = own("a"), own("b")  # the block among the largest family's rows, and among the others
    b = F.col("b")
    others = F.concat(F.array_distinct(F.transform(upto("b"), lambda k: F.least(j, k) * b + F.greatest(j, k))), F.transform(upto("a"), lambda k: b * (b + k) + j))
    dealt = F.when(F.col("family") == F.col("top"), F.transform(upto("b"), lambda k: b * (b + i) + k)).otherwise(others)
    rows = spread_join(large, open_, "group", "_group", "n", total).select(F.col("node").alias("_node"), dealt.alias("parts"))
    rest = sets.join(rows, sets["node"] == rows["_node"]).select("group", F.explode("parts").alias("part"), "node", "shingles")
    return near.unionByName(_compared(rest, similarity))


def _near_classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keys of every row, classes of texts, and the links among these: see ``near_components``.

    Returns (doc_id, raw_key, text_key), (_node, least_id, rows, first(no_id, doc_id, raw_key)) and (node, root) of components.
    """
    fp = durable(_near_keys(docs, similarity))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw_key"))
    classes = durable(fp.groupBy(F.col("text_key").alias("_node")).agg(F.min("doc_id").alias("least_id"), F.min("raw_key").alias("text_id"), F.count("*").alias("rows"), least.alias("first"), F.min("w0").alias("w0"), F.first("bands").alias("bands")))
    count = classes.count()
    close = hamming_links(classes.filter(F.size("bands") > 0).select(F.col("_node").alias("node"), "w0"), HALVES, [([0], 2)])
    keyed = classes.select("_node", F.explode("bands").alias("key"))
    met = durable(keyed.groupBy(F.col("key").alias("_key")).agg(F.min("_node").alias("u"), F.max("_node").alias("v"), F.count("*").alias("n")).filter("u < v").select("_key", "u", "n"))
    banded = spread_join(keyed, met, "key", "_key", "n", max(1, count * band_count(similarity))).filter("_node > u").select("u", F.col("_node").alias("v"))
    groups = components(close.unionByName(banded))
    wanted = durable(classes.join(groups, classes["_node"] == groups["node"]).select(F.col("_node").alias("node"), F.col("root").alias("group"), "text_id", "rows"))
    texts = docs.select("text", F.xxhash64("text").alias("text_key"))
    found = spread_join(texts, wanted, "text_key", "text_id", "rows", fp.count()).groupBy("node", "group").agg(F.first("text").alias("text"))
    links = components(jaccard_links(shingle_sets(found), similarity))
    return fp.select("doc_id", "raw_key", "text_key"), classes.drop("w0", "bands", "text_id"), links


def near_components(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, raw_key, root, component_id) of texts alike in their 5-word shingles; root names a component even if none of its ids does.

    Texts are classes by their normalised words, so copies collapse first. Candidates: classes whose 64-bit SimHash fingerprints,
    over distinct shingles, multi-index hashing finds at 2 or fewer differing bits. At ``similarity`` 0.8 fingerprints
    differ in about 10 bits of 64, which no ball of an affordable size reaches; so classes that share a band of BAND_ROWS
    minima over their shingles, directly or by way of others, are candidates too: a pair at ``similarity`` shares none with
    probability MISSED at most, whatever the edits. Linked: candidates whose distinct shingles (as 64-bit hashes) have a
    Jaccard similarity of ``similarity`` or more, by exact count. Links are transitive. Texts without words are one class,
    linked to no other.
    """
    fp, classes, links = _near_classes(docs, similarity)
    named = durable(named_classes(classes.drop("first"), links))
    out = spread_join(fp, named, "text_key", "_node", "rows", fp.count())
    return out.select("doc_id", "raw_key", "root", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` of each near-duplicate component: that of the least doc_id, null only if no row has one.

    If that id names several texts of the component, the text of least hash stays, and of rows that repeat both id and text any
    one. A doc_id that names texts of different components can stay for each of them. What stays is chosen among classes of
    texts, and texts are then moved once, to be joined with it.
    """
    fp, classes, links = _near_classes(docs, similarity)
    stay = _rooted(classes, links).groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.doc_id").alias("_millrace_doc_id"), F.col("f.raw_key").alias("_millrace_raw_key"))
    repeats = fp.groupBy("doc_id", "raw_key").agg(F.count("*").alias("_millrace_n")).filter("_millrace_n > 1")
    stay = durable(stay.join(repeats, stay["_millrace_doc_id"].eqNullSafe(repeats["doc_id"]) & (stay["_millrace_raw_key"] == repeats["raw_key"]), "left").drop("doc_id", "raw_key"))
    kept = docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(F.col("_millrace_doc_id")) & (F.xxhash64(docs["text"]) == F.col("_millrace_raw_key")))
    once = kept.filter("_millrace_n is null").select(*docs.columns)
    repeated = kept.filter("_millrace_n > 1").dropDuplicates(["_millrace_doc_id", "_millrace_raw_key"]).select(*docs.columns)
    return once.unionByName(repeated)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
