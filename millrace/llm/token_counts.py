"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, small_batches, table

#: The mark that stands before each pre-token.
SPACE = "▁"
#: Log probability by which a character outside the vocabulary falls below the least piece.
UNKNOWN_PENALTY = 10.0
#: Bytes that a Python worker's remembered terminal counts may take, about, in each of two generations. The older one goes when
#: the newer is full; counts are then computed anew.
MEMO_BYTES = 24 << 20
#: What a remembered entry takes beside its characters.
ENTRY_BYTES = 150


def vocabulary(model_file: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with Zipf log probabilities by rank: piece i of n has -log(i + 1) - log(H_n).

    The public vocabularies here come from merge training and carry ranks, not probabilities; a fixed rule turns one into
    the other, so nothing is trained. Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return {p: -math.log(i + 1) - norm for i, p in enumerate(pieces)}


class Trie:
    """Counts tokens of pre-tokens; a shared prefix is scored once.

    A node keeps the best log probability of its prefix and the number of tokens on that path. A character without a piece
    costs the penalty and counts one token for each of its UTF-8 bytes. Ties go to the longer last piece.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # lengths of the pieces that end in each pair of letters (or are one letter): no other start can give a piece
        ends: dict[str, set[int]] = {}
        for p in scores:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items()}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def count(self, words: list[str]) -> list[int]:
        """Token counts of the distinct ``words``: in sorted order the trie is walked depth first, so only one path is held."""
        get, lengths, unknown, none = self.scores.get, self.lengths, self.unknown, ()
        out: dict[str, int] = {}
        best, number = [0.0], [0]  # of the prefixes on the path to the current node
        last = ""
        for word in sorted(set(words)):
            depth = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                depth += 1
            del best[depth + 1 :], number[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                top, n = best[end - 1] + unknown, number[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                for size in lengths.get(word[end - 2 : end], none) if end > 1 else none:
                    if size <= end and (s := get(word[end - size : end])) is not None and best[end - size] + s > top:
                        top, n = best[end - size] + s, number[end - size] + 1
                s = get(word[end - 1])
                if s is not None and best[end - 1] + s > top:
                    top, n = best[end - 1] + s, number[end - 1] + 1
                best.append(top)
                number.append(n)
            last = word
            out[word] = number[-1]
        return [out[w] for w in words]


_memo: dict = {"key": None, "new": {}, "old": {}, "held": 0}


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_words, n_tokens): pre-tokens and unigram tokens of each whole text.

    Pre-tokens are the words between blanks, each behind the mark. A null or empty text has none. Repeated rows each give a
    row; other columns are ignored. Every batch adds its distinct unseen pre-tokens to a trie and keeps the terminal
    counts, up to a bounded number of bytes for each Python worker; nothing is shuffled. The vocabulary file is public and fixed; it must be on
    every machine, as the tokenizer package is.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _memo["key"] != model_file:
            _memo.update(key=model_file, new={}, old={}, held=0, trie=Trie(vocabulary(model_file)))
        trie = _memo["trie"]
        for batch in batches:
            texts = [WORD_RE.findall(t.as_py() or "") for t in batch.column(1)]
            new, old = _memo["new"], _memo["old"]
            seen = set().union(*texts)
            again = [w for w in seen if w in old and w not in new]
            new.update((w, old[w]) for w in again)
            moved = sum(map(len, again)) + ENTRY_BYTES * len(again)
            fresh = [w for w in seen if w not in new]
            new.update(zip(fresh, trie.count([SPACE + w for w in fresh]), strict=True))
            get = new.__getitem__
            counts = [sum(map(get, ws)) for ws in texts]
            _memo["held"] += sum(map(len, fresh)) + ENTRY_BYTES * len(fresh) + moved
            if _memo["held"] > MEMO_BYTES:
                _memo.update(old=new, new={}, held=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
