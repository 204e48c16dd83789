"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document's ids come as pieces of a window's length at most; a
piece goes to the open window that it fits best.  Where none fits, the fullest window is topped up with the head of the
piece and emitted, so emitted windows have no padding.  What the partitions still hold open at their ends is merged in
groups of partitions by the same rule; the rest of a group is cut at powers of two, which need no padding either.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, materialise, tidy, utf8

#: Words, and as many pieces, that a Python worker remembers, and the longest of them: bounds its memory (some 100 MB, which it
#: keeps for the stages after this one) and changes the time, not the result.
CACHE, REMEMBERED = 250_000, 48
#: Partitions whose leftovers are merged together: bounds what one task holds to GROUP * OPEN windows.
GROUP = 8
OPEN = 32
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, grp long"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):  # noqa: ANN201
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies show bytes as: printable ones as themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_SHOWN = _byte_characters()


class WordEncoder:
    """Ids of texts under a tokenizer that never joins across white space (words with end marks, white space dropped).

    Such an encoding is the concatenation over words, and within a plain word over the pieces that the pretokenizer makes
    of it in lower case; both are encoded once and remembered.  Words with characters outside Latin-1 and Latin Extended-A
    (where normalisation could change them), or that could hold a special token, go to the tokenizer whole.
    """

    PLAIN = re.compile("(?!.*<\\|)[\x21-\x7e\u00c0-\u012f\u0131-\u017f]+")
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^\\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")

    def __init__(self, path: str, most: int = CACHE) -> None:
        self.words, pieces = _caches(path)
        self.words.most = pieces.most = most

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids = self.words.__getitem__
        return [b"".join(map(ids, t.split())) for t in texts]


class _Memo(dict):
    """What `make` gives for a key, remembered; begins anew when full, as most words are met once and would fill it for good."""

    def __init__(self, make: Callable) -> None:
        self.make, self.most = make, CACHE

    def __missing__(self, key: bytes | str) -> bytes:
        value = self.make(key)
        if len(key) <= REMEMBERED:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


@functools.lru_cache(maxsize=2)
def _caches(path: str) -> tuple[_Memo, _Memo]:
    """Words and pieces that this Python worker has met, for all its tasks."""
    whole = tokenizer(path)
    merge, plain, split = whole.model.tokenize, WordEncoder.PLAIN.fullmatch, WordEncoder.PIECE.findall
    coded = [struct.pack("<I", i) for i in range(whole.get_vocab_size())]

    def of_piece(piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
        return b"".join([coded[t.id] for t in merge(shown)])

    pieces = _Memo(of_piece)

    def of_word(word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters only: one piece
            return pieces[word.lower().decode()]
        text = word.decode()
        if plain(text):
            return b"".join(map(pieces.__getitem__, split(text.lower())))
        return np.array(whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    return _Memo(of_word), pieces


class Packer:
    """Open windows and finished sequences; rows: (doc_id, start, length, doc_tokens, sequence_id, offset, ids, group)."""

    def __init__(self, size: int, open_windows: int, base: int) -> None:
        self.size, self.open, self.base, self.made, self.rows = size, [[0, []] for _ in range(open_windows)], base, 0, []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, total, self.base + self.made, offset, ids, None))
            offset += n
        self.made += 1

    def place(self, doc: int | None, start: int, total: int, ids: bytes) -> None:
        n = len(ids) // 4
        while n >= self.size:
            self.emit([(doc, start, total, ids[: 4 * self.size])])
            ids, start, n = ids[4 * self.size :], start + self.size, n - self.size
        while n:
            best, room = None, self.size + 1
            fullest = self.open[0]
            for w in self.open:
                gap = self.size - w[0]
                if n <= gap < room:
                    best, room = w, gap
                if w[0] > fullest[0]:
                    fullest = w
            if best is None:
                cut = self.size - fullest[0]
                fullest[1].append((doc, start, total, ids[: 4 * cut]))
                self.emit(fullest[1])
                fullest[0], fullest[1] = 0, []
                ids, start, n = ids[4 * cut :], start + cut, n - cut
                continue
            best[1].append((doc, start, total, ids))
            best[0] += n
            if best[0] == self.size:
                self.emit(best[1])
                best[0], best[1] = 0, []
            n = 0

    def finish(self) -> None:
        """Cuts what is open into sequences of `size` and of smaller powers of two."""
        pieces = [p for w in self.open for p in w[1]]
        left = sum(len(p[3]) for p in pieces) // 4
        at = 0
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            out = []
            while want:
                doc, start, total, ids = pieces[at]
                n = min(want, len(ids) // 4)
                out.append((doc, start, total, ids[: 4 * n]))
                want -= n
                if 4 * n == len(ids):
                    at += 1
                else:
                    pieces[at] = (doc, start + n, total, ids[4 * n :])
            self.emit(out)

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_SCHEMA = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary()), ("grp", pa.int64())])


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, open_windows: int = OPEN) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit numbers).

    A sequence is the ids of its pieces in the order of their offsets.  An empty text still has its end id.  The input's
    partitions are taken as they come, in order; a task that is run again packs the same rows the same way.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, packer = WordEncoder(path), Packer(size, open_windows, task << 32)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(utf8(part.column("text"))), strict=True):
                    ids += end
                    packer.place(doc, 0, len(ids) // 4, ids)
                if packer.rows:
                    yield packer.take(_SCHEMA)
        packer.rows += [(doc, start, len(ids) // 4, total, task, i, ids, task // GROUP) for i, (doc, start, total, ids) in enumerate(p for w in packer.open for p in w[1])]
        if packer.rows:
            yield packer.take(_SCHEMA)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = None, None
        for batch in batches:
            for doc, start, total, ids, grp in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "grp")), strict=True):
                if grp != group:
                    if packer:
                        packer.finish()
                        if packer.rows:
                            yield packer.take(_SCHEMA)
                    packer, group = Packer(size, open_windows, (1 << 62) + (grp << 32)), grp
                packer.place(doc, start, total, ids)
            if packer and packer.rows:
                yield packer.take(_SCHEMA)
        if packer:
            packer.finish()
            if packer.rows:
                yield packer.take(_SCHEMA)

    packed = materialise(documents(docs).mapInArrow(tidy(first), PIECES), "packing", small=True)
    left = packed.where("grp IS NOT NULL").repartition("grp").sortWithinPartitions("grp", "sequence_id", "offset").mapInArrow(tidy(second), PIECES)
    return packed.where("grp IS NULL").unionByName(left).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
