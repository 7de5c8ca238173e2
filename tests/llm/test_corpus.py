import collections
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from fixtures import documents, empty, rows
from pyspark.sql import functions as F

from millrace.llm import ann, chat, licences, line_dedup, mixing, packing, quality, simhash, token_counts, topk
from millrace.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# packing


def test_encoding_equals_the_tokenizers_own():
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)  # as it is: no setting is touched
    texts = [r[1] or "" for r in rows()] + ["a\x1cb", "ΌΣΟΣ ΟΔΟΣ x", "don't we'll 'S", "étude ½ x²y ªº", "<|endoftext|> a<|startoftext|>", "tab\tand wide　blank\u0085", "İstanbul", "ﬁ ǅ"]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|EndOfText|> <|endoftext|", "Σ<|startoftext|>Σ ΑΣ", "<<|endoftext|>>\u0338", "\x01a\x02 \x7f.\x1b b\x08c \x00"]
    texts += [chr(c) + "a " + chr(c) for c in range(1, 0x300)]
    rng = random.Random(7)
    anything = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    near = list(range(1, 0x250))
    for _ in range(3000):
        texts.append("".join(chr(rng.choice(near if rng.random() < 0.7 else anything)) for _ in range(rng.randint(1, 30))))
    for _ in range(300):
        texts.append(" ".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "\x03", "word", "It's", "é", chr(rng.choice(anything))]) for _ in range(9)).replace(" ", rng.choice([" ", ""])))
    got = packing.encode(texts, BPE)
    for x, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, ascii(x[:80])


def test_remembered_words_are_bounded_and_change_nothing(monkeypatch):
    words = packing._Words(BPE)
    monkeypatch.setattr(packing, "MEMO_BYTES", 5000)
    texts = [f"alpha{i} beta{i % 7}, ünit{i}" for i in range(300)] * 2
    for x in texts:
        ids = words.text(x)
        words.trim()
        assert ids == packing._Words.text(words, x) and words.held <= 6000 and len(words.old) < 30


def check_packing(got, wanted, length):
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == {d for d, _ in wanted}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= length
    total = sum(len(ids) for _, ids in wanted)
    assert sum(r["length"] for r in got) == total
    expected = collections.Counter()
    for d, ids in wanted:
        expected[d, len(ids)] += 1
    for d, pieces in by_doc.items():
        copies = collections.Counter(r["doc_tokens"] for r in pieces if r["start"] == 0)
        assert copies == {n: c for (x, n), c in expected.items() if x == d}
    ids_of = collections.defaultdict(list)
    for d, ids in wanted:
        ids_of[d, len(ids)].append(ids)
    for r in got:
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"] for ids in ids_of[r["doc_id"], r["doc_tokens"]])
    return sum(length - t for t in (sum(n for _, n in s) for s in sequences.values()) if t & (t - 1)) / total


def test_pack_is_a_partition_of_all_ids(spark):
    docs = documents(spark)
    got = packing.pack(docs, BPE).collect()
    wanted = [(r["doc_id"], np.append(np.frombuffer(packing.encode([r["text"] or ""], BPE)[0], "<u4"), 1)) for r in docs.collect()]
    assert check_packing(got, wanted, packing.LENGTH) < 0.2
    assert packing.pack(empty(spark), BPE).count() == 0


def test_padding_is_small_on_many_lengths():
    rng = np.random.default_rng(1)
    h, rests, total = collections.Counter(), collections.Counter(), 0
    for n in rng.lognormal(6.3, 1.0, 20000).astype(int) + 1:
        rests[n % 2048] += 1
        h.update(packing.cuts(int(n), rests[n % 2048] % packing.FINE_EVERY == 0))
        total += int(n)
    plan = packing.Plan(h)
    assert plan.padding / total < 0.01
    for k, c in h.items():
        assert sum(p.count(k) * n for p, n in plan.patterns) == c


# token counts


def test_token_counts_equal_a_unigram_model(spark):
    from tokenizers import Tokenizer, models

    scores = token_counts.vocabulary(PIECES)
    vocab = [("<unk>", 0.0), *scores.items()]
    model = Tokenizer(models.Unigram(vocab, 0, False))
    trie = token_counts.Trie(scores)
    words = sorted({token_counts.SPACE + w for r in rows() for w in WORD.findall(r[1] or "") if len(w) < 200 and w.isascii()})
    assert trie.count(words) == [len(model.encode(w).tokens) for w in words]
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(documents(spark), PIECES).collect()}

    def brute(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for e in range(1, len(word) + 1):
            best[e] = (best[e - 1][0] + trie.unknown, best[e - 1][1] + len(word[e - 1].encode()))
            for s in range(max(0, e - 60), e):
                if word[s:e] in scores and best[s][0] + scores[word[s:e]] > best[e][0]:
                    best[e] = (best[s][0] + scores[word[s:e]], best[s][1] + 1)
        return best[-1][1]

    memo = {}
    want = set()
    for d, text, *_ in rows():
        ws = WORD.findall(text or "")
        want.add((d, len(ws), sum(memo.setdefault(w, brute("▁" + w)) for w in ws)))
    assert got == want
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0


# chat


def test_chat_round_trip(spark):
    data = [(1, 0, "system", "\\h ### \\\\ </turn> x: y"), (1, 1, "user", "hi\n</turn>\n### Assistant: no"), (1, 2, "assistant", "yes \\"), (1, 3, "assistant", ""), (1, 4, "user", "#### end:"),
            (2, 1, "assistant", "only"), (3, 0, None, None), (3, 0, None, None), (None, None, "as: s", "z"), (4, 0, "user", "q" * 20000), (4, 1, "assistant", "é ñ\\t\\c\\h")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)).withColumn("t", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digests(chat.with_probe(df)).collect()}
    import hashlib

    tricky = "\\### Assistant: </turn> ok"
    for conv in {d[0] for d in data} | {-7}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in data if c == conv)) if conv != -7 else [(0, "user", tricky), (1, "assistant", tricky)]
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    ex = chat.examples(df).filter("conv_id = 1").orderBy("example_no").collect()
    assert [r["target_turn"] for r in ex] == [2, 3, None] and [r["is_last"] for r in ex] == [False, False, True]
    assert ex[1]["prompt"].startswith(ex[0]["prompt"] + ex[0]["completion"] + ex[0]["suffix"])
    assert chat.digests(df.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    got = simhash.simhash_components(docs).collect()
    fps = {(r[0], r[1]): plain_fingerprint(r[1]) for r in rows()}
    roots = plain_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), f in fps.items():
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    want = collections.Counter((r[0], f"{fps[r[0], r[1]]:016x}", least.get(roots[fps[r[0], r[1]]])) for r in rows())
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_hamming_links_lose_nothing_in_hot_buckets(spark, block):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    values = set(base)
    for b in base[:3]:
        for _ in range(40):
            v = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted({simhash._signed(v) for v in values})
    df = spark.createDataFrame([(v, v) for v in values], "node long, w0 long")
    links = simhash.hamming_links(df, simhash.HALVES, [([0], 2)], block=block)
    assert all(((u ^ v) & simhash.M64).bit_count() <= 2 for u, v in links.collect())
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {v: got.get(v, v) for v in values} == plain_components(values, lambda a, b: ((a ^ b) & simhash.M64).bit_count() <= 2)


@pytest.mark.parametrize("bits", [2, 3])
def test_a_large_family_is_compared_in_bounded_memory(bits):
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 20_000
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(32, bits, replace=False).astype(np.uint64)) for _ in range(n)], np.uint64)
    flips[0] = 0
    w = np.uint64(12345) ^ (flips << np.uint64(32))
    tracemalloc.start()
    u, v = simhash._compare(np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n), [w], [([0], 2)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20 and len(u) == len(v) == n - (1 if bits == 2 else 2)  # three bits away, the base row is alone
    assert (np.bitwise_count(w[u] ^ w[v]) <= 2).all()
    root = list(range(n))
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
        assert x != y


def test_no_group_of_probes_or_table_rows_grows_with_the_data(spark):
    hot = spark.range(800).selectExpr("id as node", "shiftleft(id, 32) as w0")  # one low half; its neighbours have few rows
    both = hot.unionByName(spark.range(20).selectExpr("id + 5000 as node", "shiftleft(id * 40, 32) + shiftleft(1L, cast(id % 4 as int)) as w0"))
    dealt = simhash._deal(both, simhash.HALVES, 16)
    assert dealt.groupBy("key", "part").count().agg({"count": "max"}).first()[0] <= 200
    got = {r["node"]: r["root"] for r in components(simhash.hamming_links(both, simhash.HALVES, [([0], 1)], block=16)).collect()}
    w = {r["node"]: r["w0"] for r in both.collect()}
    assert {n: got.get(n, n) for n in w} == plain_components(w, lambda a, b: (w[a] ^ w[b]).bit_count() <= 1)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard(a, b):
    s = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_are_found_and_others_left(spark):
    import random

    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    texts, pairs = [], []
    for _ in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        near = list(w)
        for _ in range(rng.randint(1, 6)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        pairs.append((len(texts), len(texts) + 1, jaccard(w, near)))
        texts += [" ".join(w), " ".join(near)]
    singles = range(len(texts), len(texts) + 150)
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 400))) for _ in singles]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    close = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(close) > 50 and sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    assert all(got[i] == i for i in singles)
    assert not any(got[a] == got[b] for a, b, j in pairs if j < 0.6)


def exact_roots(texts, width=5):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return plain_components(range(len(texts)), alike)


def edited_texts(kind, n=60, words=300):
    """Pairs of texts whose similarity of 5-word shingles is 0.80 to 0.84."""
    import random

    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(3000)}"
    out = []
    for _ in range(n):
        w = [word() for _ in range(words)]
        near = list(w)
        if kind == "block":
            k, at = rng.randint(24, 28), rng.randrange(50, 200)
            near[at : at + k] = [word() for _ in range(k)]
        elif kind == "append":
            near += [word() for _ in range(rng.randint(58, 72))]
        else:
            for at in rng.sample(range(10, words - 10, 12), rng.randint(5, 6)):
                near[at] = word()
        out += [" ".join(w), " ".join(near)]
    return out


@pytest.mark.parametrize("kind", ["block", "append", "scattered"])
def test_near_pairs_at_the_threshold_are_found(spark, kind):
    texts = edited_texts(kind)
    close = [i for i in range(0, len(texts), 2) if 0.8 <= jaccard(texts[i].split(), texts[i + 1].split()) < 0.85]
    assert len(close) >= 40
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert got == exact_roots(texts)
    assert all(got[i] == got[i + 1] for i in close)


def test_a_repeated_line_links_no_different_texts(spark):
    import random

    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(10))
    texts = ["\n".join([" ".join(word() for _ in range(150)), *[line] * 20]) for _ in range(30)]
    texts += [texts[0].replace(" ", "  "), texts[1] + " tail"]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert got == {**{i: i for i in range(30)}, 30: 0, 31: 1} == exact_roots(texts)


@pytest.mark.parametrize("limits", [(7, 1 << 18), (512, 900), (4, 300)])
def test_blocks_of_a_large_group_lose_no_link(spark, limits):
    family = edited_texts("append", 20) + edited_texts("block", 20)
    words = family[0].split()
    family += [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in range(40)]  # a family of its own, most of them directly alike
    texts = family + [family[2] + f" tail{i}" for i in range(15)]
    sets = spark.createDataFrame([(i, 3, sorted(set(simhash.shingle_hashes(simhash.normalised(t), 5).view(np.int64).tolist()))) for i, t in enumerate(texts)], "node long, group long, shingles array<long>")
    got = {r["node"]: r["root"] for r in components(simhash.jaccard_links(sets, 0.8, *limits)).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == exact_roots(texts)


def test_a_family_of_near_copies_costs_no_pairs_of_blocks(spark, monkeypatch):
    words = [f"v{i}" for i in range(300)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(300)]
    data = [(i, 1, sorted(set(simhash.shingle_hashes(simhash.normalised(t), 5).view(np.int64).tolist()))) for i, t in enumerate(texts)]
    sets = spark.createDataFrame(data, "node long, group long, shingles array<long>")
    dealt = []
    plain = simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda d, s: dealt.append(d.count()) or plain(d, s))
    got = components(simhash.jaccard_links(sets, 0.8, 20)).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {0}
    assert len(dealt) == 1 and dealt[0] < 300 + 15 * 30  # every row once, and a few pivots in each of 15 blocks


@pytest.mark.parametrize("rows_of", [lambda i: 0, lambda i: i % 4, lambda i: i])
def test_spread_join_equals_a_join(spark, rows_of):
    left = spark.createDataFrame([(rows_of(i), i) for i in range(3000)], "x long, y long")
    right = left.groupBy("x").count().selectExpr("x as kx", "count as n", "x * 2 as z").filter("kx % 5 <> 3")
    for how in ("inner", "left"):
        got = simhash.spread_join(left, right, "x", "kx", "n", 3000, how)
        want = left.join(right, F.col("x") == F.col("kx"), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[905] == 2 and ids[900] == 1 and 901 not in ids and 902 not in ids and ids[None] == 2 and 61 not in ids
    assert simhash.keep_one(empty(spark)).count() == 0
    a, b = "a b c d e f g h", "k l m n o p q r"
    same = [(None, a, None, "s1", 1), (None, a, "en", "s2", 1), (None, a.upper(), None, None, 2), (None, b, "en", "s1", 1), (5, b, "en", "s1", 1), (7, "p", "en", "s", 1), (7, "P ", "en", "s", 1), (7, "quite another text", "en", "s", 1), (8, "p", "en", "s", 1)]
    got = [(r["doc_id"], r["text"].lower().strip()) for r in simhash.keep_one(documents(spark, same)).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (5, b), (7, "p"), (7, "quite another text")], key=str)


# line dedup


def plain_cleaned(data, sites):
    seen = collections.defaultdict(set)
    first = {}
    bare = lambda x: x.strip(" \t\r")
    for d, text, _, source, _ in data:
        for i, x in enumerate((text or "").split("\n")):
            if bare(x):
                seen[bare(x)].add(source or "")
                first[bare(x)] = min(first.get(bare(x), (math.inf, 0)), (-1 if d is None else d, i))
    out = []
    for d, text, *rest in data:
        keep = [x for i, x in enumerate((text or "").split("\n")) if not bare(x) or len(seen[bare(x)]) < sites or first[bare(x)] == (-1 if d is None else d, i)]
        out.append((d, None if text is None else "\n".join(keep), *rest))
    return out


def plain_lines(data, sites):
    return collections.Counter(r[:2] for r in plain_cleaned(data, sites))


def test_line_dedup_equals_brute_force(spark):
    data = rows() + [(i, f"Shared   line {i % 40}\n\n \tfooter\r\nown {i}", "en", f"site{i % (1 + i % 40)}", 1) for i in range(1000, 1400)]
    docs = documents(spark, data)
    got = line_dedup.clean(docs)
    assert got.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == plain_lines(data, line_dedup.MIN_SITES)
    salted = line_dedup.clean(docs, sent_keys=0)  # both joins by shuffle
    assert collections.Counter((r["doc_id"], r["text"]) for r in salted.collect()) == plain_lines(data, line_dedup.MIN_SITES)
    assert line_dedup.clean(empty(spark)).count() == 0


def test_exact_counts_are_not_dealt_by_line_alone(spark):
    data = [(i, f"hot line\nown {i}", "en", f"s{i % 4}", 1) for i in range(400)]
    docs = documents(spark, data).repartition(8)
    plan = line_dedup.boilerplate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" in plan and re.search(r"hashpartitioning\(a#\d+L?, b#\d+, site#\d+", plan)
    assert line_dedup.boilerplate(docs).count() == 1


# licences


def plain_scan(data):
    """Every line, whole text and run of consecutive lines against every template."""
    out = {}
    grams = {k: set(licences.bigrams(v)) for k, v in licences.TEMPLATES.items()}
    high = (2 - licences.THRESHOLD) / licences.THRESHOLD

    def dice(unit, t):
        g = set(licences.bigrams(unit))
        return 2 * len(g & t) / (len(g) + len(t)) if g else 0

    def add(key, best, units, runs):
        now = out.get(key, (0, 0, 0))
        out[key] = max(best, now[0]), units + now[1], runs + now[2]

    for d, text, *_ in data:
        units = [x for x in (text or "").split("\n") if x]
        lines = [x for x in units if licences.tokens(x)]
        for k, t in grams.items():
            for u in units + ([text] if len(units) > 1 else []):
                if dice(u, t) >= licences.THRESHOLD:
                    add((d, k), dice(u, t), 1, 0)
            found = []
            for i, j in itertools.combinations(range(len(lines)), 2):
                run = " ".join(lines[i : j + 1])
                if len(licences.tokens(run)) <= math.ceil(len(t) * 2 * high) and dice(run, t) >= licences.THRESHOLD:
                    found.append((j, i, dice(run, t)))
            end, n = -1, 0
            for j, i, _ in sorted(found):
                if i > end:
                    end, n = j, n + 1
            if n:
                add((d, k), max(x for *_, x in found), 0, n)
    return {k: (best, max(units, runs)) for k, (best, units, runs) in out.items()}


def test_licence_scan_equals_brute_force(spark):
    mit = licences.TEMPLATES["mit"]
    extra = ["(c) ALL RIGHTS -- reserved", "Released under the MIT License", mit, mit.replace("hereby ", ""), mit.replace(", ", ",\n"), "x\n" + licences.TEMPLATES["isc"].upper(), "Licensed under CC BY-NC 4.0!\nAll rights reserved.", "Licensed  under Apache\n" * 9]
    data = rows() + [(2000 + i, x, "en", "s", 1) for i, x in enumerate(extra)] + [(2000, extra[0], "en", "s", 1)]
    got = {(r["doc_id"], r["licence"]): (r["dice"], r["matches"]) for r in licences.scan(documents(spark, data)).collect()}
    want = plain_scan(data)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    assert {(2002, "mit"), (2004, "mit"), (2005, "isc"), (2006, "rights-reserved")} <= got.keys()
    assert licences.scan(empty(spark)).count() == 0


def test_wrapped_headers_inside_long_texts_are_found(spark):
    import textwrap

    prose = "\n".join(" ".join(f"word{i * 9 + k} of the" for k in range(4)) for i in range(60))
    names = ["apache-2.0-header", "gpl-3.0-header", "isc", "mit", "bsd-2-clause", "bsd-3-clause", "zlib", "mpl-2.0-header", "lgpl-2.1-header", "unlicense"]
    data = [(i, f"{prose}\n\n" + textwrap.fill(licences.TEMPLATES[n], 70).replace(".\n", ".\n\n") + f"\n\n{prose}", "en", "s", 1) for i, n in enumerate(names)]
    twice = textwrap.fill(licences.TEMPLATES["isc"], 60)
    data += [(20, f"{prose}\n{twice}\n{prose}\n{twice}", "en", "s", 1), (21, prose, "en", "s", 1)]
    # a licence file: copyright lines, the text as it is published, with its indents, bullets and blank lines
    mit = licences.TEMPLATES["mit"].replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    data.append((22, "MIT License\n\nCopyright (c) 2020 A. N. Other\n\n" + "\n\n".join(textwrap.fill(p, 78) for p in mit.split("\n\n")), "en", "s", 1))
    bsd = licences.TEMPLATES["bsd-3-clause"]
    for mark in "123":
        bsd = bsd.replace(f" {mark}. ", "\n\n * ")
    data.append((23, "Copyright (c) 1999, The Others. All rights reserved.\n\n" + "\n".join(textwrap.fill(p, 72, subsequent_indent="   ") for p in bsd.split("\n")), "en", "s", 1))
    gnu = "as published; see below.\n" + prose + "\nHow to use it\n\n" + textwrap.indent(textwrap.fill(licences.TEMPLATES["gpl-3.0-header"], 64), "    ") + "\n\n    This program is distributed in the hope that\n    it will be useful\n" + prose
    data.append((24, gnu, "en", "s", 1))
    code = "\n".join(f" * {x}" for x in textwrap.wrap(licences.TEMPLATES["apache-2.0-header"], 76))
    data.append((25, f"/*\n{code}\n */\nint main() {{ return 0; }}\n{prose}", "en", "s", 1))
    got = {(r["doc_id"], r["licence"]): (r["dice"], r["matches"]) for r in licences.scan(documents(spark, data)).collect()}
    assert {(i, n) for i, n in enumerate(names)} | {(20, "isc"), (22, "mit"), (23, "bsd-3-clause"), (24, "gpl-3.0-header"), (25, "apache-2.0-header")} <= got.keys() and not any(d == 21 for d, _ in got)
    assert all(got[i, n][0] > 0.95 for i, n in enumerate(names)) and got[20, "isc"][1] == 2


# vectors


def vectors(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 16))
    data = [(i, [float(np.float32(x)) for x in centres[i % 10] + 0.4 * rng.normal(size=16)]) for i in range(n)]
    data += [(n + i, data[0][1]) for i in range(60)]  # ties
    data += [(5000, None), (5050, [None] + [1.0] * 15), (5100, [math.nan] + [1.0] * 15), (5150, [math.inf] + [1.0] * 15), (None, data[3][1]), (7, data[7][1]), (5200, [0.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).withColumn("rank", F.lit(1)).repartition(5)
    good = [(i, np.array(v, float)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return df, good


def test_exact_topk_equals_brute_force(spark, monkeypatch):
    df, good = vectors(spark)
    q = [(i, np.floor(256 * v).astype(int)) for i, v in good]
    for block in (4096, 3):
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, block=block).collect()]
        want = []
        for i, v in dict(q).items():
            if i % 50 == 0:
                best = sorted((-int(v @ c), j) for j, c in q if j != i)[:5]
                want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
        assert sorted(got) == sorted(want)
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk.top_k(few).count() == 2 and topk.top_k(df.limit(0)).count() == 0


def test_vectors_of_other_lengths_take_no_part(spark):
    data = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)] + [(i, [9.0] * (i % 5 + 4)) for i in range(100, 160)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    few = df.filter("vec_id < 100")
    for search in (topk.top_k, ann.search):
        got, want = ([tuple(r) for r in search(d).orderBy("query_id", "rank").collect()] for d in (df, few))
        assert got == want and {r[0] for r in got} == {0, 50}
    big = spark.createDataFrame([(0, [1e16]), (1, [1e16])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.top_k(big).collect()] == [(1 << 63) - 1]  # held at the end of 64 bits; an error before


def test_topk_stays_exact_for_large_components(spark):
    df = spark.createDataFrame([(0, [3e6, -1e6]), (1, [3e6, 1.0]), (2, [3e6 + 1 / 256, 1.0]), (3, [-2e6, 5.0])], "vec_id long, embedding array<double>")
    v = {0: (768000000, -256000000), 1: (768000000, 256), 2: (768000001, 256), 3: (-512000000, 1280)}
    want = sorted(((-(v[0][0] * v[i][0] + v[0][1] * v[i][1]), i) for i in (1, 2, 3)))
    assert [(-r["score"], r["vec_id"]) for r in topk.top_k(df).orderBy("rank").collect()] == want


def test_ann_recall(spark):
    df, good = vectors(spark, 1500)
    good = [(i, v) for i, v in good if v.any()]
    got = collections.defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = total = 0
    for i, v in dict(good).items():
        if i % 50:
            continue
        cos = {}
        for j, c in good:
            if j != i:
                cos[j] = float(v @ c / (np.linalg.norm(v) * np.linalg.norm(c)))
        kth = sorted(cos.values(), reverse=True)[4]
        assert len(got[i]) == 5 and all(abs(cos[j] - s) < 1e-12 for j, s in got[i])
        assert got[i] == sorted(got[i], key=lambda x: (-x[1], x[0]))
        hit += sum(s >= kth - 1e-12 for _, s in got[i])
        total += 5
    assert hit >= 0.9 * total
    assert ann.search(df.limit(0)).count() == 0


# quality


def test_quality_learns_rules_and_scores_alike(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    data, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(30, 200))]
        bad = i % 4 == 0
        data.append((i, " ".join(x + "$$$" for x in w) if bad else " ".join(w) + ".", "en", "s", 1))
        labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (3, None, 1), (9999, 0, 0), (4, 7, 0)]
    docs = documents(spark, data + rows()[-10:])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, lab)
    assert rules.rules and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in [r["_id"] for r in lab.select(F.col("doc_id").alias("_id")).filter(~quality.held_out(F.col("doc_id"))).collect()] if i is not None)
    got = quality.scored(docs, rules)
    assert got.columns == [*docs.columns, "_score"]
    for r in got.select("doc_id", "text", "_score").collect():
        assert 0 <= r["_score"] <= 1 and abs(r["_score"] - rules.score(np.array([quality.statistics(r["text"])]))[0]) < 1e-12
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert (r["_score"] >= 0.5) == (r["doc_id"] % 4 != 0)
    assert quality.scored(empty(spark), quality.fit(empty(spark), lab)).count() == 0
    assert quality.fit(docs, lab.limit(0)).column(F.col("x")) is not None


def plain_statistics(text):
    """The statistics, each by its own plain pass over characters, words or lines."""
    chars, words = list(text or ""), WORD.findall(text or "")
    if not words:
        return dict.fromkeys(quality.STATS, 0.0)
    n, k = len(chars), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    among = lambda marks: sum(c in marks for c in chars)
    punctuation = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return {
        "chars": math.log1p(n), "words": math.log1p(k), "word_length": sum(len(w) for w in words) / k, "upper": among("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, "digit": among("0123456789") / n,
        "other_ascii": among(punctuation) / n, "symbol": among("#$%&*@^~<>{}[]\\_=+|") / n, "symbol_words": sum(not w.isalnum() and not w[:-1].isalnum() for w in words) / k,
        "pipe": among("|") / k, "exclaim": among("!") / k, "stop": among(".") / k, "comma": among(",") / k, "non_ascii": sum(len(c.encode()) for c in chars if ord(c) > 127) / n,
        "distinct_words": len(set(words)) / k, "distinct_lines": len(set(lines)) / len(lines) if lines else 0.0, "line_words": math.log1p(k / max(1, len(lines))), "longest_word": math.log1p(max(len(w) for w in words)),
        "top_word": max(words.count(w) for w in set(words)) / k, "upper_words": sum(w.isupper() for w in words) / k, "alpha_words": sum(w.isalpha() for w in words) / k}


def test_quality_equals_brute_force(spark):
    """Scores from plain statistics, the rules taken one by one; held-out flags from zlib; the same fit under another partitioning."""
    data = [r for r in rows() if len(r[1] or "") < 30000]
    docs = documents(spark, data)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(72)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert rules == quality.fit(docs.repartition(7), labels.repartition(2))
    got = collections.Counter((r["doc_id"], r["text"], round(r["_score"], 9), r["held"]) for r in quality.scored(docs, rules).withColumn("held", quality.held_out(F.col("doc_id"))).collect())
    want = collections.Counter()
    for d, text, *_ in data:
        stats = plain_statistics(text)
        total = rules.bias
        for conditions, weight in rules.rules:
            if all((stats[quality.STATS[f]] > t) == above for f, above, t in conditions):
                total += weight
        want[d, text, round(1 / (1 + math.exp(-total)), 9), d is not None and zlib.crc32(str(d).encode()) % 3 == 1] += 1
    assert got == want


# mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_quality_fits_one_row_of_each_labelled_id(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:20]
    data = [(i, f"text of {i}", "en", "s", 1) for i in ids] + [(ids[0], "hot " * k, "en", "s", 1) for k in range(1, 200)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit_rules", lambda x, y: (x, y))
    x, y = quality.fit(documents(spark, data), labels, sample=20)
    assert x.shape == (20, len(quality.STATS)) and y.tolist() == [i % 2 for i in ids]


def test_mix_meets_targets(spark):
    data = rows(n=300)
    docs = documents(spark, data)
    sizes = collections.Counter()
    for _, text, _, source, _ in data:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    plans = [mixing.mix(docs, chunk=c).collect() for c in (10, mixing.CHUNK, mixing.CHUNK)]
    assert sorted(map(str, plans[1])) == sorted(map(str, plans[2]))
    for plan in plans:
        assert sum(r["n"] for r in plan) == len(data)
        taken, largest = collections.Counter(), collections.Counter()
        for r in plan:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
            taken[r["source"]] += r["size"] * r["n"] * r["copies"]
            largest[r["source"]] = max(largest[r["source"]], r["size"] * r["n"])
        assert all(abs(taken[s] - want[s]) <= 0.5 * largest[s] + 1e-6 for s in sizes)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["n"] * r["copies"] for r in plans[1])
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_reads_a_table_as_a_stage_does(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["n"] * r["copies"] for r in mixing.mix(docs).collect()) > 0
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_targets_of_very_many_sources(spark):
    sizes = {f"site {i * 7919 % 5003:04d}": 1 + i * i % 97 for i in range(3000)} | {None: 40, "": 3, "\U00010000": 5, "\uffff": 9}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    want = plain_targets(sizes)
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_pivotal_rounding_keeps_mass_and_expectations():
    import random

    rng = random.Random(6)
    size = sorted((rng.randint(1, 50) for _ in range(12)), reverse=True)
    p = [0.3] * 12
    total, both = [0.0] * 12, collections.Counter()
    for i in range(6000):
        out, at, x = mixing.pairwise(size, p, random.Random(i))
        got = [x if k == at else o for k, o in enumerate(out)]
        assert abs(sum(a * b for a, b in zip(size, got)) - 0.3 * sum(size)) < 1e-6
        total = [a + b for a, b in zip(total, got)]
        for j, k in itertools.combinations(range(12), 2):
            both[j, k] += got[j] * got[k]
    assert all(abs(t / 6000 - 0.3) < 0.03 for t in total)
    # pairs of documents are rounded against one another, never alike
    assert all(both[j, k] / 6000 - total[j] * total[k] / 6000**2 < 0.02 for j, k in both)


def test_small_documents_are_not_decided_by_one_coin():
    import random

    size, p = [20_000, *[10] * 400], [0.5] * 401
    for i in range(40):
        out, _, _ = mixing.pairwise(size, p, random.Random(i))
        assert 120 < sum(out[1:]) < 280


# the pipeline


def plain_keep_one(data):
    """One row of each class of texts that exact similarities of 0.8 or more over 5-word shingles link."""
    norm = lambda r: " ".join(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")))
    sets = {}
    for t in {norm(r) for r in data}:
        w = t.split(" ") if t else []
        sets[t] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = plain_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    least = {}
    for r in data:
        if r[0] is not None:
            least[root[norm(r)]] = min(r[0], least.get(root[norm(r)], r[0]))
    return [r for r in data if r[0] == least.get(root[norm(r)])]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    data = []
    for i in range(240):
        w = [word() for _ in range(rng.randint(30, 200))]
        text = " ".join(x + "$$$" for x in w) if i % 4 == 0 else "\n".join(" ".join(w[j : j + 20]) for j in range(0, len(w), 20)) + "\nread more on our site" * (i % 3 == 0)
        data.append((i, text, "en", f"s{i % 7}" if i % 5 else "hot", len(text)))
    for i in range(1, 120, 5):  # copies and near copies
        w = data[i][1].split(" ")
        w[len(w) // 2] = "edited"
        data += [(300 + i, data[i][1], "en", "s2", 1), (500 + i, " ".join(w), "en", "s3", 1)]
    data += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \n ", "en", None, 3), (None, "a b c d e f", "en", "s1", 1), (903, " ".join(word() for _ in range(6000)), "en", "s2", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rules = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r in data if rules.score(np.array([quality.statistics(r[1])]))[0] >= 0.5]
    assert not any(r[0] is not None and r[0] < 240 and r[0] % 4 == 0 for r in kept) and sum(r[0] is not None and r[0] < 240 for r in kept) == 180
    cleaned = plain_cleaned(kept, line_dedup.MIN_SITES)
    assert sum("read more" in (r[1] or "") for r in cleaned) == 1
    once = plain_keep_one(cleaned)
    assert len(once) <= len(cleaned) - 25  # 18 exact copies, and most near ones
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = collections.Counter(r["doc_id"] for r in got if r["start"] == 0)
    sizes, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for d, text, _, source, _ in once:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        taken[source] += n * copies[d]
        most[source] = max(most[source], n)
    want = plain_targets(sizes)
    assert set(copies) <= {r[0] for r in once} and len(once) == len({r[0] for r in once})
    for d, text, _, source, _ in once:
        ratio = want[source] / sizes[source] if sizes[source] else 0
        assert math.floor(ratio + 1e-9) <= copies[d] <= math.ceil(ratio - 1e-9)
    assert all(abs(taken[s] - want[s]) <= 0.5 * most[s] + 1e-6 for s in sizes)
    ids = [(r[0], np.append(np.frombuffer(packing.encode([r[1] or ""], BPE)[0], "<u4"), 1)) for r in once for _ in range(copies[r[0]])]
    check_packing(got, ids, packing.LENGTH)


def test_the_first_two_stages_keep_their_columns_and_clean_rows(spark, tmp_path):
    import corpus_pipeline

    data = [(i, ("junk$$$ " * 40 if i % 3 == 0 else f"A plain sentence of words, number {i}, stands here and goes on for a while.\nall sites say this"), "en", f"s{i % 6}", 1) for i in range(300)]
    data += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, "A plain sentence of some words stands here.", "en", "s1", 1)]
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, data)
    kept = corpus_pipeline.quality_filter(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i in range(300) if i % 3} <= ids and not any(i % 3 == 0 for i in ids if i is not None and i < 300) and None in ids
    cleaned = corpus_pipeline.lines(spark, kept, str(tmp_path))
    assert cleaned.columns == kept.columns and cleaned.count() == kept.count()
    got = cleaned.filter("doc_id < 300").collect()
    assert sum("all sites say this" in r["text"] for r in got) == 1 and all(r["n_chars"] == len(r["text"]) and f"number {r['doc_id']}," in r["text"] for r in got)
    for stage in (corpus_pipeline.quality_filter, corpus_pipeline.lines, corpus_pipeline.near_duplicates, corpus_pipeline.mix, corpus_pipeline.pack):
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0


def test_the_pipeline_leaves_no_table_but_its_result(spark, tmp_path):
    import os

    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    documents(spark, rows(n=9)).write.parquet(f"{tmp_path}/documents.parquet")
    where = re.sub("^file:/*", "/", corpus_pipeline.shared_dir(spark))
    before = set(os.listdir(where))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    new = [x for x in set(os.listdir(where)) - before if x.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{where}/{new[0]}") == ["4"]
