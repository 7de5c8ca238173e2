"""SetSketch near-duplicates, hard negatives, the Merkle manifest, and fixes of earlier operators, each against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from fixtures import CLASHES, documents, empty, rows
from pyspark.sql import functions as F

from millrace.llm import chat, licences, merkle, negatives, packing, quality, setsketch, topk

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


# SetSketch


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_rows(data):
    """(doc_id, n_shingles, component_id, kept) of every row, all pairs being compared."""
    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(data):
        least.setdefault(find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((r[0], len(sets[i]), c := least[find(i)], r[0] == c) for i, r in enumerate(data)), key=str)


def family(seed, n, words, edits, first, shared=None):
    rng = random.Random(seed)
    base = [f"f{seed}x{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w), "en", "s1", 1))
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_setsketch_equals_brute_force(spark, block):
    data = rows() + family(1, 14, 120, 3, 2000) + family(2, 14, 60, 6, 3000)
    # a chain around the threshold, a passage that many share, one repeated line
    chain = [f"c{i}" for i in range(100)]
    data += [(4000 + k, " ".join(chain[k * 3 : k * 3 + 60]), "en", "s2", 1) for k in range(8)]
    passage = " ".join(f"p{i}" for i in range(70))
    data += [(5000 + k, passage + " " + " ".join(f"q{k}y{i}" for i in range(40)), "en", "s2", 1) for k in range(12)]
    got = setsketch.near_duplicates(documents(spark, data), block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == near_rows(data)


def test_setsketch_of_no_documents(spark):
    got = setsketch.near_duplicates(empty(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0


def test_registers_merge_and_estimate():
    factors = setsketch.multipliers(0.85)
    rng = np.random.default_rng(3)
    for n, m, both in ((900, 900, 820), (500, 500, 100), (1000, 700, 690), (40, 42, 38)):
        h = rng.integers(0, 1 << 64, n + m - both, np.uint64)
        a, b = h[:n], h[n - both :]
        u, v, w = (setsketch.registers(setsketch.least_hashes(x, factors)) for x in (a, b, h))
        assert (np.maximum(u, v) == w).all()
        more, less = setsketch._counts(u[None], v[None])
        jaccard = both / (n + m - both)
        ok = setsketch.likely(more, less, np.array([n]), np.array([m]), len(u), 0.85)[0]
        assert ok == (jaccard > 0.8), jaccard
    # far from the threshold nothing passes, at the threshold nothing is lost
    lost = passed = 0
    for k in range(300):
        h = rng.integers(0, 1 << 64, 400, np.uint64)
        for both, what in ((340, "at"), (200, "far")):  # 340 of 400 in common: 0.85
            a, b = (setsketch.registers(setsketch.least_hashes(x, factors)) for x in (h[: both + (400 - both) // 2], np.r_[h[:both], h[both + (400 - both) // 2 :]]))
            more, less = setsketch._counts(a[None], b[None])
            n = both + (400 - both) // 2
            ok = setsketch.likely(more, less, np.array([n]), np.array([400 - n + both]), len(a), 0.85)[0]
            lost += what == "at" and not ok
            passed += what == "far" and ok
    assert not lost and not passed


# hard negatives


def mined(data, every, k, n):
    good = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in data if i is not None and v and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    sizes = collections.Counter(len(v) for _, v, _ in good)
    top = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    good = [g for g in good if len(g[1]) == top]
    anchors = {}
    for i, v, y in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (y, v) in anchors.items():
        s = [(-sum(p * q for p, q in zip(v, c, strict=True)), i, z) for i, c, z in good if i != a]
        for ps, pid, _ in sorted(x for x in s if x[2] == y)[:k]:
            neg = sorted(x for x in s if x[2] != y and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:n]
            out += [(a, pid, r, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(neg, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "clustered"), [(1024, 32768, False), (3, 40, True)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, chunk, clustered):
    monkeypatch.setattr(negatives, "ANCHORS_PER_PIVOT", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5))
    data = []
    for i in range(400):
        v = centres[i % 6] * (1 + i % 3) + rng.normal(size=5) * 0.1 if clustered else rng.normal(size=5)
        data.append((i, [float(x) for x in v.round(1)], int(rng.integers(0, 4))))
    data += [(1000 + i, data[10][1], 1) for i in range(60)] + [(20, data[21][1], 0), (30, data[30][1], data[30][2])]  # one vector many times, ids twice
    data += [(None, [1.0] * 5, 1), (2000, None, 1), (2010, [1.0, None, 1.0, 1.0, 1.0], 1), (2020, [float("nan")] * 5, 1), (2030, [1.0] * 5, None), (2040, [float("inf")] * 5, 2), (2050, [1.0, 2.0], 1), (2060, [], 1), (2070, [0.0] * 5, 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in CLASHES if c not in ("size",)}).repartition(3)
    got = negatives.mine(df, every=10, positives=5, negatives=10, block=block, chunk=chunk)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined(data, 10, 5, 10)


def test_hard_negatives_of_huge_components_and_of_nothing(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-9, 10, 3)], int(i % 2)) for i in range(40)] + [(40, [3e7, -1e7, 2e7], 0), (41, [1e9, 1e9, 0.0], 1), (50, [2.0**40, 0.0, 1.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = [(a, p, r, n, cut(s), cut(t)) for a, p, r, n, s, t in mined(data, 10, 5, 10)]
    assert sorted(tuple(r) for r in negatives.mine(df, every=10).collect()) == want
    assert negatives.mine(df.filter("vec_id < 0")).count() == 0 and negatives.mine(df.filter("vec_id in (1, 2)")).count() == 0


def test_cells_leave_out_candidates_of_far_clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 1000
    c = np.floor(centres[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * 20)
    cells = negatives._Cells(centres.copy(), float((c * c).sum(1).max()))
    at, far = cells.of_anchors(c[:400])
    assert (at == np.arange(400) % 40).all()
    best = np.sort(c[:400] @ c.T, 1)[:, -10]
    norm = (c[:400] ** 2).sum(1)
    cells.radius, cells.near, cells.far = (np.zeros(40) for _ in range(3))
    np.maximum.at(cells.radius, at, far)
    np.maximum.at(cells.near, at, np.sqrt(norm + cells.top - 2 * best))
    sent = cells.served(c)
    needed = (c[:400] @ c.T >= best[:, None]).T
    assert not any((needed[:, at == k].any(1) & ~sent[:, k]).any() for k in range(40)) and sent.mean() < 0.5


# the Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def plain_leaf(row, text):
    doc_id, _, lang, source, n = row
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)])


def tree_of(leaves):
    """The root, and of each leaf the siblings left and right by level."""
    paths, now, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(now) > 1:
        for p, i in zip(paths, at, strict=True):
            run = i // 16 * 16
            p.append(("".join(now[run:i]), "".join(now[i + 1 : run + 16])))
        now, at = [h(*now[i : i + 16]) for i in range(0, len(now), 16)], [i // 16 for i in at]
    return now[0], paths


def manifest_rows(data):
    by = collections.defaultdict(list)
    for r in data:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees[s] = tree_of([plain_leaf(r, r[1]) for r in by[s]])
    root, above = tree_of([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            path = path + up
            seen = r[1].translate(LOW) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]
            folded = plain_leaf(r, seen)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r[0], plain_leaf(r, r[1]), trees[s][0], root, h(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=str)


def manifest_check(df):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return merkle.check(df, F.when(crc % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text")))


def test_manifest_equals_brute_force(spark):
    data = rows() + [(905, "one", "en", "é", 3)] * 3
    first = 10_000
    for source, n in (("lone", 1), ("a16", 16), ("a17", 17), ("a256", 256), ("a257", 257), ("hot", 700), ("Z", 3), ("é2", 2), ("日本", 18), ("", 2)):
        data += [(first + i * 7, f"Text {i} Of {source}" if i % 3 else None, "EN" if i % 2 else None, source, i) for i in range(n)]
        first += 10_000
    got = manifest_check(documents(spark, data))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == manifest_rows(data)
    assert 0 < got.filter("not verified").count() < len(data) / 3


def test_manifest_of_more_levels_and_of_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SENT_ROWS", 0)
    data = [(i, f"T{i}", "en", "s" if i % 5 else f"t{i % 3}", i) for i in range(900)]
    for part in (data, data[:1], data[:2]):
        assert sorted((tuple(r) for r in manifest_check(documents(spark, part)).collect()), key=str) == manifest_rows(part)
    assert manifest_check(empty(spark)).count() == 0


# fixes


def test_marks_in_capitals_beside_letters_whose_small_letter_is_far():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(file), random.Random(3)
    letters = [chr(c) for c in range(0x181, 0x250)] + list("aZ<|>xI ") + ["İ"]
    marks = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>"]
    texts = ["".join(rng.choice(marks) if rng.random() < 0.3 else rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(5000)] + ["<|ENDOFTEXT|>Ɨ", "Ɨ<|ENDOFTEXT|>"]
    for x, ids in zip(texts, packing.encode(texts, file), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, ascii(x)


def test_a_column_named_like_the_score_stays(spark):
    rules = quality.Rules(0.0, [])
    docs = documents(spark).withColumns({"_score": F.lit("mine"), "_millrace_stats": F.lit("too")})
    got = quality.scored(docs, rules, "score")
    assert got.columns == [*docs.columns, "score"] and {tuple(r) for r in got.select("_score", "_millrace_stats").distinct().collect()} == {("mine", "too")}
    with pytest.raises(ValueError, match="already"):
        quality.scored(docs, rules)


def test_topk_of_huge_components(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.integers(-50, 50, 4)]) for i in range(60)] + [(60, [1e30, -1e30, 0.0, 1.0]), (61, [2.0**50, 1.0, 0.0, 0.0]), (62, [-(2.0**60), 3.0, 0.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), every=20)
    q = {i: [int(np.floor(256 * x)) if abs(x) < 2**40 else int(256 * x) for x in v] for i, v in data}
    cut = lambda x: max(-(1 << 63) + 1, min((1 << 63) - 1, x))
    want = []
    for a in (0, 20, 40, 60):
        s = sorted((-cut(sum(x * y for x, y in zip(q[a], v, strict=True))), i) for i, v in q.items() if i != a)[:5]
        want += [(a, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_licence_scan_time_is_linear_in_lines(spark):
    header = licences.TEMPLATES["apache-2.0-header"].split(" ")
    wrapped = "\n".join(" ".join(header[i : i + 9]) for i in range(0, len(header), 9))

    def took(n):
        text = "\n".join(f"log line {i} of the software" for i in range(n)) + "\n" + wrapped
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        got = {r["licence"]: r["dice"] for r in licences.scan(df).collect()}
        assert got["apache-2.0-header"] > 0.95
        return time.time() - start

    took(100)
    assert took(40_000) < took(10_000) * 5 + 8


def test_prompt_totals_equal_those_of_all_prompts(spark):
    data = [(1, 0, "system", "\\h ### x: y"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "assistant", ""), (1, 4, "user", "end"), (2, 1, "assistant", "only é"), (3, 0, None, None), (None, None, "user", "z"), (None, 5, "assistant", "w")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = {}
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    for r in chat.examples(df).collect():
        turns = [t + chat.CLOSE for t in r["prompt"].split(chat.CLOSE)]
        if r["target_turn"] is None:
            turns = turns[:-1]
        else:
            turns[-1] = turns[-1].removesuffix(chat.CLOSE)
        n, chars, total = want.get(r["conv_id"], (0, 0, 0))
        want[r["conv_id"]] = n + 1, chars + len(r["prompt"]), (total + sum(i * number(t) for i, t in enumerate(turns, 1))) % chat.PRIME
    assert {r["conv_id"]: (r["n_examples"], r["prompt_chars"], r["prompt_digest"]) for r in chat.digests(df).collect()} == want


def test_digests_read_every_prompt(spark, monkeypatch):
    data = [(1, i, "user" if i % 2 else "assistant", f"text {i}") for i in range(301)] + [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    right = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert [right[c]["n_examples"] for c in (1, 2)] == [151, 2]
    expanded = chat._expanded
    monkeypatch.setattr(chat, "_expanded", lambda conv: expanded(conv).withColumn("prompt", F.when(F.col("example_no") == 1, F.concat(F.lit("?"), "prompt")).otherwise(F.col("prompt"))))
    for r in chat.digests(df).collect():
        assert r["prompt_chars"] == right[r["conv_id"]]["prompt_chars"] + 1 and r["prompt_digest"] != right[r["conv_id"]]["prompt_digest"]
        assert r["turns_sha256"] == right[r["conv_id"]]["turns_sha256"]
