"""Byte-level BPE, encoding and decoding, by matrices.

A text is split by the pretokenizer pattern; only pieces that the task hasn't met yet are merged.  Those are bucketed by
length into padded numpy matrices of ids.  Each round finds, for every row at once, its leftmost pair of minimum rank by
a hashed pair table, merges it, compacts the row by one place and retires rows without a mergeable pair.

A row of n bytes takes up to n rounds of n places, so rows past LONGEST bytes go the same way with a queue of their pairs by
rank and place instead: n log n steps, the same merges in the same order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches_of, documents, tidy

#: Entries of a task's piece cache; it is emptied when full, which changes the time taken, not the result.
CACHE = 400_000
#: Longest piece that is remembered, so that the cache's bytes are bounded, too.
REMEMBERED = 64
#: Bytes of a piece that is merged as a row of a matrix.
LONGEST = 512
#: Pieces of a text, and ids, that are handled at a time.
SLICE = 1 << 17
NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of a tiktoken file: pieces by id, and an open-addressing table from a pair of ids to the merged id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [(self.ranks[a], self.ranks[b], rank) for piece, rank in self.ranks.items() for i in range(1, len(piece)) if (a := piece[:i]) in self.ranks and (b := piece[i:]) in self.ranks]
        left, right, merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.bits = max(4, int(len(pairs) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        key, todo = (left << 32) | right, np.arange(len(pairs))
        slot = self._slot(key)
        while len(todo):  # place all at once; those that found a taken slot move on by one
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = key[todo[free]]
            placed = self.keys[slot[todo]] == key[todo]
            self.values[slot[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that a pair merges to, which is its rank; NONE without one."""
        key = (left << 32) | right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.full(key.shape, NONE, dtype=np.int64)
        todo = np.flatnonzero(key.ravel() != -2)
        key, slot, flat = key.ravel(), slot.ravel(), out.ravel()
        while len(todo):
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            flat[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers.  A piece of any length is merged whole."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (known := self.ranks.get(piece)) is not None:
                out[i] = known.to_bytes(4, "little")
            elif len(piece) > LONGEST:
                out[i] = self._merge_long(piece)
            else:
                n = len(piece)
                by_width.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            step = max(1, (1 << 18) // max(1, width))
            for a in range(0, len(rows), step):
                self._merge([pieces[i] for i in rows[a : a + step]], rows[a : a + step], width, out)
        return out

    def _merge(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        ids = np.full((len(pieces), width + 1), -1, dtype=np.int64)
        for r, piece in enumerate(pieces):
            ids[r, : len(piece)] = self.byte_id[np.frombuffer(piece, np.uint8)]
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rank = self.merged(ids[:, :-1], ids[:, 1:])
        alive = np.arange(len(pieces))
        while True:
            at = rank.argmin(axis=1)  # the leftmost of the least
            value = rank[np.arange(len(ids)), at]
            done = value >= NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[alive[r]]] = ids[r, : length[r]].astype("<u4").tobytes()
                go = ~done
                ids, rank, length, alive, at, value = ids[go], rank[go], length[go], alive[go], at[go], value[go]
                if not len(ids):
                    return
                width = int(length.max())
                ids, rank = ids[:, : width + 1], rank[:, :width]
            n = np.arange(len(ids))
            keep = np.ones(ids.shape, dtype=bool)
            keep[n, at + 1] = False
            ids[n, at] = value
            ids = np.concatenate([ids[keep].reshape(len(ids), -1), np.full((len(ids), 1), -1, dtype=np.int64)], axis=1)
            rank = np.concatenate([self._shift(rank, at), np.full((len(ids), 1), NONE, dtype=np.int64)], axis=1)
            rank[n, at] = self.merged(ids[n, at], ids[n, at + 1])
            before = np.maximum(at - 1, 0)
            rank[n[at > 0], before[at > 0]] = self.merged(ids[n, before], ids[n, at])[at > 0]
            length = length - 1

    def _merge_long(self, piece: bytes) -> bytes:
        """One long piece.  Ends of tokens are a linked list over its bytes; a queue holds each pair's rank and place, and entries
        that a merge has outdated are passed over."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by a token's first byte: its end, and the first byte of the one before
        alive = bytearray(b"\1") * n
        first = np.frombuffer(piece, np.uint8)
        rank = self.merged(self.byte_id[first[:-1]], self.byte_id[first[1:]])
        at = np.flatnonzero(rank < NONE)
        queue = list(zip(rank[at].tolist(), at.tolist(), (at + 2).tolist(), strict=True))
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, a, stop = pop(queue)
            if not alive[a]:
                continue
            b = end[a]
            if b >= n or end[b] != stop:  # one of both has grown since
                continue
            alive[b] = 0
            end[a] = stop
            if stop < n:
                before[stop] = a
                if (r := ranks.get(piece[a : end[stop]])) is not None:
                    push(queue, (r, a, end[stop]))
            if (c := before[a]) >= 0 and (r := ranks.get(piece[c:stop])) is not None:
                push(queue, (r, c, stop))
        ids, a = [], 0
        while a < n:
            ids.append(ranks[piece[a : end[a]]])
            a = end[a]
        return np.array(ids, dtype="<u4").tobytes()

    @staticmethod
    def _shift(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank without the place after `at` in each row (without the last where `at` is the last)."""
        keep = np.ones(rank.shape, dtype=bool)
        keep[np.arange(len(rank)), np.minimum(at + 1, rank.shape[1] - 1)] = False
        return rank[keep].reshape(len(rank), -1)

    def decode(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([b"".join([pieces[i] for i in ids[a : a + SLICE].tolist()]) for a in range(0, len(ids), SLICE)])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a piece cache of bounded size."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE) -> None:
        self.vocabulary, self.pattern, self.cache, self.most = vocabulary(path), regex.compile(pattern), {}, cache

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.  Short texts are encoded together, 4 SLICE characters at a
        time; a longer one alone, a slice of its pieces at a time."""
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > SLICE:
                found, parts = self.pattern.finditer(t), []
                while some := [m.group() for m in itertools.islice(found, SLICE)]:
                    parts += self._encode([some])
                out[i] = b"".join(parts)
                continue
            group.append(i)
            size += len(t)
            if size > 4 * SLICE:
                self._together(texts, group, out)
                group, size = [], 0
        self._together(texts, group, out)
        return out

    def _together(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        for i, ids in zip(group, self._encode([self.pattern.findall(texts[i]) for i in group]), strict=True):
            out[i] = ids

    def _encode(self, split: list[list[str]]) -> list[bytes]:
        if len(self.cache) > self.most:
            self.cache.clear()
        cache = self.cache
        new = list({p for pieces in split for p in pieces if p not in cache})
        ids = dict(zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True))
        long = {p: i for p, i in ids.items() if len(p) > REMEMBERED}
        cache.update((p, i) for p, i in ids.items() if len(p) <= REMEMBERED)
        return [b"".join([cache[p] if p in cache else long[p] for p in pieces] if long else [cache[p] for p in pieces]) for pieces in split]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary).  Empty text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                ids = encoder.encode(part.column("text").to_pylist())
                back = [encoder.vocabulary.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(tidy(run), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, computed beside the ids so that these needn't move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                ids = encoder.encode(part.column("text").to_pylist())
                back = [encoder.vocabulary.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["Encoder", "Vocabulary", "encode", "round_trip", "vocabulary"]
