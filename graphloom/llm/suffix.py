"""Repeated byte strings by a sparse suffix array, range-partitioned.

Only suffixes that begin at minimisers are kept: the position, among the 31 that a 50-byte string offers for its 20-byte
heads, whose head has the least hash (the leftmost of equals).  Equal strings have equal minimisers at equal distances, so
comparing the suffixes there, to the right and to the left, compares all strings of 50 bytes.

A sample of the leading tokens (the first eight bytes of a suffix) gives splitters; suffixes are range-partitioned by them.
Each bucket sorts its suffixes by multikey quicksort over eight-byte tokens, in numpy, likewise the reversed bytes to their
left.  Runs of common prefixes of the needed lengths then identify equal strings, and the smallest document of each.
Splitters are compared with whole leading tokens, so suffixes that agree in their token fall into one bucket.  A token that
fills more than one bucket shows as repeated splitters.  Its suffixes aren't sorted in one place: their 50-byte strings, which
are what is compared across the borders of buckets, are dealt evenly by a hash of their further tokens, each block sending a
string once, and are sorted there in the same way.  Hashes choose places only: what counts as equal is compared byte by byte.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Parts, arrays, columns, deal, exchange, key_parts, parts_row, per_block, read_shared, shared_keys, squeeze, expand, store, with_answers
from .common import SPANS, id_array, materialise, mix, partitions, powers, removed, runs_of

LENGTH, HEAD = 50, 20
SPAN = LENGTH - HEAD + 1  # heads of one string
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE_BITS = 20  # positions that the minimiser's order tells apart
PIECE = 1 << _PLACE_BITS  # bytes of a text that are looked at together; pieces overlap by all but one byte of a string
SAMPLE = 16  # leading tokens of a block that go into the splitters
STEP = 1 << 19


def _minimisers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a text: first and last string start of each run with the same minimiser, the minimiser's place, its head's hash.
    Every string of 50 bytes lies whole in one piece, so memory is bounded and equal strings are treated alike."""
    step = PIECE - LENGTH + 1
    found = [_minimisers_of(data[a : a + PIECE]) for a in range(0, max(1, len(data) - LENGTH + 1), step)]
    if len(found) == 1:
        return found[0]
    at = [i * step for i in range(len(found))]
    return *(np.concatenate([f[k] + a for f, a in zip(found, at, strict=True)]) for k in range(3)), np.concatenate([f[3] for f in found])


def _minimisers_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    empty = np.zeros(0, dtype=np.int64)
    n = len(data)
    if n < LENGTH:
        return empty, empty, empty, empty.view(np.uint64)
    up, down = powers(_BASE, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    head = mix((sums[HEAD:] - sums[:-HEAD]) * down[: n - HEAD + 1])
    mask = np.uint64(PIECE - 1)
    v = (head & ~mask) | np.arange(len(head), dtype=np.uint64)
    m = v
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])  # minima over 2, 4, 8, 16
    m = np.minimum(m[: len(m) - (SPAN - 16)], m[SPAN - 16 :])
    start = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    last = np.append(start[1:], len(m)) - 1
    place = (m[start] & mask).astype(np.int64)
    return start, last, place, head[place]


class _Block:
    """A block's bytes and the suffixes at its minimisers."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join([*texts, b"\0" * 8]), dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.cumsum(lengths) - lengths
        parts = [_minimisers(self.data[b : b + n]) for b, n in zip(self.base.tolist(), lengths.tolist(), strict=True)]
        self.text = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
        shift = self.base[self.text] if len(texts) else self.text
        self.start, self.last, self.place = (np.concatenate([p[k] for p in parts]) + shift for k in range(3))
        self.keys = np.concatenate([p[3] for p in parts])
        self.owner = ids[self.text]

    def tokens(self, place: np.ndarray) -> np.ndarray:
        """The eight bytes from each place as a big-endian number."""
        out = np.zeros(len(place), dtype=np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self.data[place + k].astype(np.uint64)
        return out

    def strings(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs with shared heads: their places among all, one of each distinct content, its smallest owner, and
        each run's content."""
        at = np.flatnonzero(shared)
        if not len(at):
            return at, at, at, at
        start, size = self.start[at], self.last[at] - self.start[at] + LENGTH
        ends = np.cumsum(size)
        code = np.empty(len(at), dtype=np.uint64)
        step = np.concatenate(([0], np.searchsorted(ends, np.arange(STEP, ends[-1] + STEP, STEP), "right")))
        for a, b in zip(step[:-1].tolist(), np.append(step[1:-1], len(at)).tolist(), strict=True):
            if a == b:
                continue
            lo, hi = int(start[a]), int((start[a:b] + size[a:b]).max())
            up, down = powers(_BASE, hi - lo + 1)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data[lo:hi]] * up[:-1], out=sums[1:])
            s = start[a:b] - lo
            code[a:b] = mix((sums[s + size[a:b]] - sums[s]) * down[s])
        code = mix(code ^ (size.astype(np.uint64) << np.uint64(32)) ^ (self.place[at] - start).astype(np.uint64))
        order = np.argsort(code, kind="stable")
        new = np.concatenate(([True], code[order][1:] != code[order][:-1]))
        if self._differ(at, order, new):  # two contents with one hash: these are told apart by their bytes, all in one sort
            order, new = self._by_bytes(at, code)
        first = np.flatnonzero(new)
        which = np.empty(len(at), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return at, at[order][first], np.minimum.reduceat(self.owner[at][order], first), which


    def _rows(self, runs: np.ndarray) -> np.ndarray:
        """The runs' bytes, filled up to one width, behind their length and the place of their minimiser."""
        start, size = self.start[runs], self.last[runs] - self.start[runs] + LENGTH
        col = np.arange(LENGTH + SPAN)
        rows = np.zeros((len(runs), 2 + len(col)), dtype=np.uint8)
        rows[:, 0], rows[:, 1] = size, self.place[runs] - start
        rows[:, 2:] = np.where(col < size[:, None], self.data[np.minimum(start[:, None] + col, len(self.data) - 1)], 0)
        return rows

    def _differ(self, at: np.ndarray, order: np.ndarray, new: np.ndarray) -> bool:
        """Whether neighbours that share a hash have different bytes."""
        again = np.flatnonzero(~new)
        for a in range(0, len(again), 1 << 14):
            i = again[a : a + (1 << 14)]
            if (self._rows(at[order[i]]) != self._rows(at[order[i - 1]])).any():
                return True
        return False

    def _by_bytes(self, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self._rows(at)
        order = np.lexsort((*rows.T[::-1], code))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (rows[order][1:] != rows[order][:-1]).any(axis=1)
        return order, new


def multikey_order(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of tokens, column by column: after each one only rows that are still tied with another are sorted further.
    Returns the order and, for each row but the first in it, the column of its first difference from the row before."""
    n, width = tokens.shape
    order = np.argsort(tokens[:, 0], kind="stable")
    differs = np.full(n, width, dtype=np.int64)
    first = tokens[order, 0]
    differs[1:][first[1:] != first[:-1]] = 0
    if n:
        differs[0] = 0
    for k in range(1, width):
        tied = differs == width
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(differs[at] < width)  # rows of one run of ties
        value = tokens[order[at], k]
        inner = np.lexsort((value, group))
        order[at] = order[at[inner]]
        value = value[inner]
        new = np.zeros(len(at), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) & (group[1:] == group[:-1])
        differs[at[new]] = k
    return order, differs


def _common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows and the common prefix of each with the row before it there."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    order, differs = multikey_order(padded.view(">u8").astype(np.uint64))
    common = np.full(n, width, dtype=np.int64)
    if n:
        common[0] = 0
        at = np.flatnonzero(differs[1:] < padded.shape[1] // 8) + 1
        for k in range(8):  # within the first token that differs
            here = differs[at] * 8 + k
            same = padded[order[at], here] == padded[order[at - 1], here]
            common[at[~same]] = np.minimum(here[~same], width)
            at = at[same]
    return order, common


def _distinct(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of LENGTH bytes: one of each, the smallest owner of each, and each row's number among them."""
    order, common = _common(rows)
    new = common < LENGTH
    at = np.flatnonzero(new)
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[at], np.minimum.reduceat(owner[order], at) if len(at) else owner[:0], which


class _Strings:
    """The distinct strings of contents whose leading token is hot."""

    def __init__(self, b: _Block, content: np.ndarray, owner: np.ndarray) -> None:
        count = b.last[content] - b.start[content] + 1
        self.of = np.repeat(np.arange(len(content)), count)
        self.k = np.arange(len(self.of)) - np.repeat(np.cumsum(count) - count, count)
        start = b.start[content][self.of] + self.k
        rows = np.empty((len(start), LENGTH), dtype=np.uint8)
        for a in range(0, len(start), 1 << 16):
            rows[a : a + (1 << 16)] = b.data[start[a : a + (1 << 16), None] + np.arange(LENGTH)]
        one, self.least, self.which = _distinct(rows, owner[self.of])
        self.rows, self.owner = rows[one], owner
        code = np.ones(len(one), dtype=np.uint64)
        padded = np.zeros((len(one), -(-LENGTH // 8) * 8), dtype=np.uint8)
        padded[:, :LENGTH] = self.rows
        for word in padded.view("<u8").astype(np.uint64).T:
            code = mix(code * _BASE + word)
        self.code = code

    def masks(self, elsewhere: np.ndarray) -> np.ndarray:
        hit = elsewhere[self.which] | (self.least[self.which] < self.owner[self.of])
        out = np.zeros(len(self.owner), dtype=np.uint64)
        np.bitwise_or.at(out, self.of[hit], np.uint64(1) << self.k[hit].astype(np.uint64))
        return out


def _answers(parts: list[bytes]) -> list[bytes]:
    """Contents are tagged 0, strings of hot tokens 1; a bucket has parts of one kind."""
    return (_string_answers if parts[0][:1] == b"\1" else _bucket_answers)([p[1:] for p in parts])


def _string_answers(parts: list[bytes]) -> list[bytes]:
    """For each part the bits of strings that a document with a smaller id than the block's smallest has."""
    got = []
    for p in parts:
        head = struct.unpack_from("<q", p)[0]
        got.append((arrays(p[8 : 8 + head])[0], np.frombuffer(expand(p[8 + head :]), np.uint8).reshape(-1, LENGTH)))
    owner = np.concatenate([o for o, _ in got])
    _, least, which = _distinct(np.concatenate([r for _, r in got]), owner)
    out = least[which] < owner
    ends = np.cumsum([len(o) for o, _ in got])
    return [np.packbits(out[e - len(o) : e]).tobytes() for e, (o, _) in zip(ends.tolist(), got, strict=True)]


def _bucket_answers(parts: list[bytes]) -> list[bytes]:
    """For each part a mask a content: bit k is set if its k-th string is in a document with a smaller id elsewhere."""
    got, sizes = [], []
    for p in parts:
        head = struct.unpack_from("<q", p)[0]
        owner, ahead, count = arrays(p[8 : 8 + head])
        got.append((owner, ahead.astype(np.int64), count.astype(np.int64), np.frombuffer(expand(p[8 + head :]), np.uint8)))
        sizes.append(len(owner))
    owner, ahead, count = (np.concatenate([g[k] for g in got]) for k in range(3))
    raw = np.concatenate([g[3] for g in got])
    n, left = len(owner), SPAN - 1
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    rows = np.zeros((n, left + LENGTH), dtype=np.uint8)
    for a in range(0, n, 1 << 14):  # some at a time: the places take eight times the bytes
        part = slice(a, min(n, a + (1 << 14)))
        lo, each = int(begin[a]), size[part]
        col = np.arange(int(each.sum())) - np.repeat(begin[part] - lo - (left - ahead[part]), each)
        rows[np.repeat(np.arange(a, part.stop), each), col] = raw[lo : lo + len(col)]
    right_order, right_common = _common(rows[:, left:])
    left_order, left_common = _common(np.ascontiguousarray(rows[:, :left][:, ::-1]))
    mask = np.zeros(n, dtype=np.uint64)
    first = left - ahead  # the column of a content's first string
    for c in range(SPAN):
        use = np.flatnonzero((first <= c) & (c < first + count))
        if len(use) < 2:
            continue
        right, back = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        right[right_order] = np.cumsum(right_common < c + LENGTH - left)
        back[left_order] = np.cumsum(left_common < left - c)
        key = (right[use] << 32) | back[use]
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        least = np.minimum.reduceat(owner[use][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = use[order][least < owner[use][order]]
        mask[hit] |= np.uint64(1) << (c - first[hit]).astype(np.uint64)
    ends = np.cumsum(sizes)
    return [columns(mask[e - k : e].astype(np.uint32)) for e, k in zip(ends.tolist(), sizes, strict=True)]


def cut_strings(docs: DataFrame, hot_from: int = 2) -> DataFrame:
    """Per document: doc_id, n_bytes, spans, kept.

    spans are the removed bytes, as (start, end) without the end, in order; kept is what stays, as bytes (a cut may fall inside
    a character).

    A byte goes where a string of 50 bytes covers it that also starts in a document with a smaller doc_id.  Strings don't
    cross documents; rows with the same doc_id don't remove each other's bytes.  A leading token is hot, and spread, if
    `hot_from` splitters or more equal it.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)

    def heads(ids: np.ndarray, texts: list[bytes]) -> tuple[Parts, list[int]]:
        b = _Block(ids, texts)
        chosen = b.place[np.argsort(b.keys, kind="stable")[:: max(1, len(b.keys) // SAMPLE)][:SAMPLE]] if len(b.keys) else b.place
        return key_parts(b.keys, b.owner, buckets), (b.tokens(chosen) >> np.uint64(1)).astype(np.int64).tolist()

    blocks = store(docs, heads, buckets)
    first = materialise(exchange(blocks, shared_keys, 1), "heads")
    # Quantiles of sampled leading tokens; Spark's sketch of them is bounded by its accuracy, not by the data.
    split = blocks.select(F.explode("sample").alias("t")).agg(F.percentile_approx("t", [i / buckets for i in range(1, buckets)], 10000).alias("q")).first()["q"] if buckets > 1 else []
    splitters = np.array(split or [], dtype=np.int64)

    token, times = np.unique(splitters, return_counts=True)
    hot = token[times >= hot_from]

    def dealt(b: _Block, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of contents that are sorted, their buckets, and the places of hot ones."""
        token = (b.tokens(b.place[content]) >> np.uint64(1)).astype(np.int64)
        often = np.isin(token, hot)
        cold = np.flatnonzero(~often)
        return cold, np.searchsorted(splitters, token[cold], "right"), np.flatnonzero(often)

    def contents(block: int, ids: np.ndarray, texts: list[bytes], answers: dict) -> pa.RecordBatch | None:
        b = _Block(ids, texts)
        _, content, owner, _ = b.strings(read_shared(b.keys, answers.get(1, {}), buckets))
        out = []
        cold, place, often = dealt(b, content)
        for k, at in deal(place, buckets):
            at = cold[at]
            c = content[at]
            size = b.last[c] - b.start[c] + LENGTH
            where = np.repeat(b.start[c] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            head = columns(owner[at], (b.place[c] - b.start[c]).astype(np.uint8), (b.last[c] - b.start[c] + 1).astype(np.uint8))
            out.append({"bucket": k, "data": b"\0" + struct.pack("<q", len(head)) + head + squeeze(b.data[where].tobytes())})
        if len(often):
            s = _Strings(b, content[often], owner[often])
            for k, at in deal((s.code % np.uint64(buckets)).astype(np.int64), buckets):
                head = columns(s.least[at])
                out.append({"bucket": buckets + k, "data": b"\1" + struct.pack("<q", len(head)) + head + squeeze(s.rows[at].tobytes())})
        return parts_row(block, out)

    def remove(block: int, ids: np.ndarray, texts: list[bytes], answers: dict) -> pa.RecordBatch:
        b = _Block(ids, texts)
        runs, content, owner, which = b.strings(read_shared(b.keys, answers.get(1, {}), buckets))
        mask = np.zeros(len(content), dtype=np.uint64)
        cold, place, often = dealt(b, content)
        for k, at in deal(place, buckets):
            mask[cold[at]] = arrays(answers[2][k])[0]
        if len(often):
            s = _Strings(b, content[often], owner[often])
            elsewhere = np.zeros(len(s.code), dtype=bool)
            for k, at in deal((s.code % np.uint64(buckets)).astype(np.int64), buckets):
                elsewhere[at] = np.unpackbits(np.frombuffer(answers[2][buckets + k], np.uint8), count=len(at))
            mask[often] = s.masks(elsewhere)
        edge = np.zeros(len(b.data) + 1, dtype=np.int16)  # strings that begin or end at a byte
        mine = np.where(b.owner[runs] > owner[which], np.uint64(0xFFFFFFFF), mask[which])
        for k in range(SPAN):
            s = b.start[runs] + k
            s = s[(s <= b.last[runs]) & ((mine >> np.uint64(k)) & np.uint64(1)).astype(bool)]
            edge[s] += 1  # no string begins at a byte twice
            edge[s + LENGTH] -= 1
        gone = np.cumsum(edge[:-1], dtype=np.int16) > 0
        spans, kept = [], []
        for t, at in zip(texts, b.base.tolist(), strict=True):
            g = gone[at : at + len(t)]
            found = runs_of(g)
            spans.append(found)
            kept.append(np.frombuffer(t, np.uint8)[~g].tobytes() if found else t)
        return pa.RecordBatch.from_arrays([id_array(ids), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    second = exchange(per_block(with_answers(blocks, first), contents, "block long, parts array<struct<bucket:int,data:binary>>"), _answers, 2)
    return per_block(with_answers(blocks, first.unionByName(second)), remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    """Per document of cut_strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut.select("doc_id", "n_bytes", removed("spans"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def repeated_strings(docs: DataFrame, hot_from: int = 2) -> DataFrame:
    """The digests of cut_strings, straight from it."""
    return digests(cut_strings(docs, hot_from))
