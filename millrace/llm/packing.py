"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, small_batches, table

LENGTH = 2048
#: The id that ends each document.
END = 1
#: Bytes that a Python worker's remembered words may take, about, in each of two generations.
MEMO_BYTES = 64 << 20
#: What a remembered word takes beside its characters and ids.
ENTRY_BYTES = 190
#: Of the documents with equal rests every so many is cut to powers of two, which fill the space that whole rests leave.
FINE_EVERY = 16

_memo: dict = {}
# Fixed value: the pre-token pattern that the vocabulary file names.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Outside this range lower-casing and composition are left to the tokenizer itself; controls 28 to 31 only look like blanks to Python.
_FAR = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")
_BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")
_STOPS = frozenset(".,!?;:|#$%&*")


def _letters() -> dict[int, str]:
    """For characters below U+0250, and those that they become in lower case, the letters that a byte-level vocabulary writes for their UTF-8 bytes.

    Printable bytes stand as themselves, the others as the characters from U+0100 on, in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)}
    return {ord(x): "".join(letter[b] for b in x.encode()) for c in range(0x250) for x in chr(c) + chr(c).lower()}


class _Words(dict):
    """Ids of words without ASCII blanks; a word that is not there is looked up in the older generation, or encoded."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.file, self.old, self.parts, self.letters = file, {}, {}, _letters()
        self.held = 0
        self.tokenizer = Tokenizer.from_file(file)
        self.merge = self.tokenizer.model.tokenize
        # the vocabulary's own marks are cut out of the raw text before anything else
        self.marks = {t.content: array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marked = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")") if self.marks else re.compile("(?!)")
        self.start = os.path.commonprefix([*self.marks])

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.encode(word)
        self[word] = got
        self.held += len(word) + len(got) + ENTRY_BYTES
        return got

    def text(self, x: str) -> bytes:
        """Ids of a whole text."""
        if self.start in x and self.marked.search(x):
            return b"".join(self.marks[p] if p in self.marks else self.text(p) for p in self.marked.split(x) if p)
        if _FAR.search(x):
            return b"".join(map(self.__getitem__, _BLANKS.split(x)))
        # lower case could turn other letters into a mark: such a text's words stay as they are
        return b"".join(map(self.__getitem__, x.split() if self.start in x else x.lower().split()))

    def encode(self, word: str) -> bytes:
        low = word.lower()
        if _FAR.search(word) or _FAR.search(low):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        word = low
        if word.isalpha():
            return self.merged(word)
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return self[word[:-1]] + self.part(word[-1])
        return b"".join(map(self.part, _PRETOKEN.findall(word)))

    def merged(self, pre: str) -> bytes:
        shown = pre if pre.isascii() and pre.isprintable() else pre.translate(self.letters)
        return array("I", [x.id for x in self.merge(shown)]).tobytes()

    def part(self, pre: str) -> bytes:
        """Ids of a pre-token; letters are remembered as words, marks and digits apart."""
        if len(pre) > 1 and pre.isalpha():
            return self[pre]
        got = self.parts.get(pre)
        if got is None:
            got = self.parts[pre] = self.merged(pre)
        return got

    def trim(self) -> None:
        if self.held > MEMO_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
        if len(self.parts) > 10_000:
            self.parts.clear()


def encode(texts: list[str], file: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit integers, without an end mark: those of a plain
    ``encode(text, add_special_tokens=False)``, which gives a mark of the vocabulary that stands in a text the mark's id.

    The vocabulary's pre-tokens never reach over a blank, so words between ASCII blanks are encoded on their own and remembered,
    up to a bounded number of bytes for each Python worker.
    """
    if _memo.get("file") != file:
        _memo.update(file=file, words=_Words(file))
    words = _memo["words"]
    out = []
    for x in texts:
        out.append(words.text(x))
        words.trim()
    return out


def cuts(n: int, fine: bool, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: full sequences, then the rest, whole or, if ``fine``, as its powers of two."""
    full, rest = divmod(n, length)
    return [length] * full + ([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if fine else [rest] * bool(rest))


def pieces(docs: DataFrame, file: str, length: int = LENGTH, fine: int = FINE_EVERY) -> DataFrame:
    """(doc_id, part, rank, start, length, ids_crc32, doc_tokens): all pieces, each with its rank within (part, length).

    part is the task that encoded the document. Of each task's documents with the same rest every ``fine``-th is cut to powers of
    two. The rows go to the shared folder, so ranks stay as they are; ids need not be kept.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "part", "rank", "start", "length", "ids_crc32", "doc_tokens"]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, rests = TaskContext.get().partitionId(), defaultdict(int), defaultdict(int)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, data in zip(batch.column(0).to_pylist(), encode([t.as_py() or "" for t in batch.column(1)], file), strict=True):
                data += end
                n = len(data) // 4
                rests[n % length] += 1
                at = 0
                for k in cuts(n, rests[n % length] % fine == 0, length):
                    for c, v in zip(cols, (doc, part, ranks[k], at, k, zlib.crc32(data[4 * at : 4 * (at + k)]), n), strict=True):
                        c.append(v)
                    ranks[k] += 1
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names)))


class Plan:
    """Where every piece goes, from the histogram of lengths alone.

    The rank-th piece of a length goes to the run of ``slots[length]`` that holds the rank: arrays of first rank, first sequence and
    offset, one run for each place of the length in a pattern.
    """

    def __init__(self, histogram: dict[int, int], length: int = LENGTH):
        self.patterns = shortest_pack_first(histogram, length)
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        sequence = 0
        for p, c in self.patterns:
            at = 0
            for r in p:
                runs[r].append((ranks[r], sequence, at))
                ranks[r] += c
                at += r
            sequence += c
        self.sequences = sequence
        self.slots = {r: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for r, v in runs.items()}
        self.padding = sum((length - sum(p)) * c for p, c in self.patterns if sum(p) & (sum(p) - 1))

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for r in np.unique(lengths):
            own = np.flatnonzero(lengths == r)
            first, to, at = self.slots[int(r)]
            run = np.searchsorted(first, ranks[own], "right") - 1
            sequence[own], offset[own] = to[run] + ranks[own] - first[run], at[run]
        return sequence, offset


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts. Lengths go longest first, each into the packs with most space left; if it fits in
    none, packs are opened. All packs of one pattern move together, so the work depends on lengths and patterns only."""
    by_space: dict[int, list[list]] = defaultdict(list)
    spaces: list[int] = []  # sorted
    for r in sorted(histogram, reverse=True):
        count = histogram[r]
        while count > 0:
            space = spaces[-1] if spaces else -1
            if space < r:
                group = [(r,), count]
                count = 0
            else:
                pattern, packs = by_space[space].pop()
                if not by_space[space]:
                    spaces.pop()
                n = min(count, packs)
                if n < packs:
                    if not by_space[space]:
                        spaces.append(space)
                    by_space[space].append([pattern, packs - n])
                group = [(*pattern, r), n]
                count -= n
            left = length - sum(group[0])
            if not by_space[left]:
                bisect.insort(spaces, left)
            by_space[left].append(group)
    return sorted(((tuple(p), c) for groups in by_space.values() for p, c in groups), key=lambda x: (sum(x[0]), x[0]), reverse=True)


def pack(docs: DataFrame, file: str, length: int = LENGTH, fine: int = FINE_EVERY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document is cut into full sequences and a rest; the rests are packed whole, but for every ``fine``-th of a length, whose
    powers of two fill what the others leave. Null and empty texts are a lone end mark. Repeated rows are packed each; an empty
    table gives an empty result. The histogram has at most ``length`` entries however many documents there are, and it alone
    reaches the driver. Ranks within a length come from the counts of each encoding task, so neither texts nor ids are
    shuffled, and a length that a third of all documents share is as good as any.
    """
    spark = docs.sparkSession
    cut = pieces(docs, file, length, fine)
    counts = durable(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    plan = spark.sparkContext.broadcast(Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
