"""Repeated passages of words, by difference-cover anchors.

Windows of 20 words are hashed only at positions whose residue modulo 31 lies in a perfect difference cover of six
residues.  Whatever the positions of two equal runs of 50 words, some offset below 31 brings both to cover positions, so
the runs share an aligned anchor.  Shared anchors (of two documents anywhere) are then extended: every run of 50 words
around one is fingerprinted whole, and the document with the smallest id that has it is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Parts, columns, deal, exchange, key_parts, parts_row, per_block, read_shared, shared_keys, smaller_elsewhere, store, with_answers
from .common import SPANS, Words, grams, id_array, materialise, partitions, removed, runs_of

#: {0, 1, 3, 8, 12, 18} modulo 31: each difference of residues occurs once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Block:
    """A block's words, its anchors and, given which anchors are shared, its candidate windows."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int) -> None:
        self.words, self.window, self.anchor = Words(texts), window, window - PERIOD + 1
        n = len(self.words.start)
        self.text = np.repeat(np.arange(len(texts)), self.words.count)
        self.place = np.arange(n) - np.repeat(self.words.first, self.words.count)
        self.left = np.repeat(self.words.count, self.words.count) - self.place  # words from here to the text's end
        self.owner = ids[self.text]
        self.at = np.flatnonzero(_IN_COVER[self.place % PERIOD] & (self.left >= self.anchor))
        self.keys = grams(self.words.hash, self.anchor)[self.at]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a shared anchor."""
        n = len(self.place)
        edge = np.zeros(n + 1, dtype=np.int64)
        p = self.at[shared]
        np.add.at(edge, np.maximum(p - (PERIOD - 1), p - self.place[p]), 1)
        np.add.at(edge, p + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.window))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows (64-bit and 32-bit fingerprints, smallest owner in the block) and each start's window."""
        if not len(starts):
            z = np.zeros(0, dtype=np.uint64)
            return z, z.astype(np.uint32), z.astype(np.int64), z.astype(np.int64)
        a = grams(self.words.hash, self.window)[starts]
        b = grams(self.words.hash, self.window, check=True)[starts].astype(np.uint32)
        order = np.argsort(a, kind="stable")
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        first = np.flatnonzero(new)
        which = np.empty(len(a), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return a[order][first], b[order][first], np.minimum.reduceat(self.owner[starts][order], first), which


def cut_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per document: doc_id, n_words, spans, kept.

    spans are the removed words, as (start, end) in words without the end, in order; kept is the text that stays.

    A word goes where a window of `window` words covers it whose sequence also starts in a document with a smaller doc_id.
    Rows with the same doc_id don't remove each other's words.  The kept words are joined by one space.
    """
    if window < 2 * PERIOD - 12:
        raise ValueError("the window must hold an anchor at every alignment")
    spark = docs.sparkSession
    buckets = partitions(spark)

    def anchors(ids: np.ndarray, texts: list[bytes]) -> tuple[Parts, list[int]]:
        b = _Block(ids, texts, window)
        return key_parts(b.keys, b.owner[b.at], buckets), []

    def candidates(block: int, ids: np.ndarray, texts: list[bytes], answers: dict) -> pa.RecordBatch | None:
        b = _Block(ids, texts, window)
        h, check, owner, _ = b.windows(b.candidates(read_shared(b.keys, answers.get(1, {}), buckets)))
        return parts_row(block, [{"bucket": k, "data": columns(h[at], check[at], owner[at])} for k, at in deal((h % np.uint64(buckets)).astype(np.int64), buckets)])

    def remove(block: int, ids: np.ndarray, texts: list[bytes], answers: dict) -> pa.RecordBatch:
        b = _Block(ids, texts, window)
        starts = b.candidates(read_shared(b.keys, answers.get(1, {}), buckets))
        h, _, owner, which = b.windows(starts)
        elsewhere = np.zeros(len(h), dtype=bool)
        for k, at in deal((h % np.uint64(buckets)).astype(np.int64), buckets):
            elsewhere[at] = np.unpackbits(np.frombuffer(answers[2][k], np.uint8), count=len(at))
        starts = starts[elsewhere[which] | (b.owner[starts] > owner[which])]
        edge = np.zeros(len(b.place) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans, kept = [], []
        for t, first, count in zip(texts, b.words.first.tolist(), b.words.count.tolist(), strict=True):
            words, g = t.split(), gone[first : first + count]
            found = runs_of(g)
            if found:
                words = [w for w, x in zip(words, g.tolist(), strict=True) if not x]
            spans.append(found)
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([id_array(ids), pa.array(b.words.count), pa.array(spans, SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_words", "spans", "kept"])

    blocks = store(docs, anchors, buckets)
    first = materialise(exchange(blocks, shared_keys, 1), "anchors")
    second = exchange(per_block(with_answers(blocks, first), candidates, "block long, parts array<struct<bucket:int,data:binary>>"), smaller_elsewhere, 2)
    cut = per_block(with_answers(blocks, first.unionByName(second)), remove, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary")
    return cut.withColumn("kept", F.col("kept").cast("string"))


def digests(cut: DataFrame) -> DataFrame:
    """Per document of cut_passages: doc_id, n_words, n_removed, kept_sha256."""
    return cut.select("doc_id", "n_words", removed("spans"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """The digests of cut_passages, straight from it."""
    return digests(cut_passages(docs, window))
