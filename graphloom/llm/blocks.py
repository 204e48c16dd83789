"""Block exchange: finding what documents share without moving the documents.

Documents are stored once in compressed blocks of some thousand rows, in a table bucketed by block.  A block summarises its
texts as sorted distinct keys, dealt into buckets; a bucket sees the keys of all blocks and answers each block with a few
bits per key, in the block's own order.  However often a key occurs, a block sends it once, so no group is hot; answers
are joined to the stored blocks without moving these.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CREATED, batches_of, documents, ids_of, partitions, tidy, utf8

#: Text of a block: so much for each bucket that it deals keys to, within these bounds, so that parts don't get tiny.
PER_BUCKET, LEAST_BYTES, MOST_BYTES = 32 << 10, 4 << 20, 16 << 20
PARTS = "array<struct<bucket:int,data:binary>>"
_PART = pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())]))


def block_bytes(buckets: int) -> int:
    return min(MOST_BYTES, max(LEAST_BYTES, PER_BUCKET * buckets))


def labels(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n buckets such that hashing them to n partitions puts one bucket in each."""
    rows = spark.range(n * 24).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()  # one row a partition
    found = [r["id"] for r in sorted(rows, key=lambda r: r["p"])]
    spare = iter(range(n * 24, n * 25))
    return np.array(found + [next(spare) for _ in range(n - len(found))], dtype=np.int64)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def columns(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed buffer; integers are split by byte place, so that equal high bytes vanish."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        kind = raw.dtype.str.encode()
        body = raw.view(np.uint8).reshape(-1, raw.dtype.itemsize).T.tobytes()
        out.append(struct.pack("<4sq", kind, raw.size) + body)
    return squeeze(b"".join(out))


def arrays(data: bytes) -> list[np.ndarray]:
    raw, at, out = expand(data), 0, []
    while at < len(raw):
        kind, size = struct.unpack_from("<4sq", raw, at)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        body = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at + 12).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(body.T).reshape(-1).view(dtype))
        at += 12 + size * dtype.itemsize
    return out


def pack_texts(ids: np.ndarray, texts: list[bytes]) -> bytes:
    return squeeze(struct.pack("<q", len(texts)) + ids.tobytes() + np.fromiter(map(len, texts), np.int64, len(texts)).tobytes() + b"".join(texts))


def unpack_texts(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = expand(data)
    n = struct.unpack_from("<q", raw)[0]
    ids, lengths = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = 8 + 16 * n + np.cumsum(lengths)
    return ids, [raw[b - k : b] for b, k in zip(ends.tolist(), lengths.tolist(), strict=True)]


def deal(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket that occurs, in order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets), "right")
    start = 0
    for b, end in enumerate(ends.tolist()):
        if end > start:
            yield b, order[start:end]
        start = end


Parts = list[dict]


def store(docs: DataFrame, summarise: Callable[[np.ndarray, list[bytes]], tuple[Parts, list[int]]], buckets: int) -> DataFrame:
    """Writes the blocks: block, texts, parts (the first summary of each block), sample (some values of its own)."""
    spark = docs.sparkSession
    most = block_bytes(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            every = np.concatenate(ids)
            parts, sample = summarise(every, texts)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([pack_texts(every, texts)], pa.binary()), pa.array([parts], _PART), pa.array([sample], pa.list_(pa.int64()))], ["block", "texts", "parts", "sample"])

        for batch in batches:
            for part in batches_of(batch, "text", most // 4):
                new = utf8(part.column("text"))
                ids.append(ids_of(part.column("doc_id")))
                texts += new
                size += sum(map(len, new))
                if size >= most:
                    yield block()
                    made, ids, texts, size = made + 1, [], [], 0
        if texts:
            yield block()

    name = f"blocks_{uuid.uuid4().hex}"
    documents(docs).mapInArrow(tidy(run), f"block long, texts binary, parts {PARTS}, sample array<long>").write.format("parquet").bucketBy(buckets, "block").sortBy("block").option("compression", "zstd").saveAsTable(name)
    CREATED.append(("table", name))
    return spark.table(name)


def exchange(parts: DataFrame, answer: Callable[[list[bytes]], list[bytes]], stage: int) -> DataFrame:
    """(block, parts) to (block, stage, bucket, data): each bucket's parts are answered together, one answer a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def done(bucket: int) -> pa.RecordBatch:
            rows = held.pop(bucket)
            out = answer([d for _, d in rows])
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([stage] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(out, pa.binary())], ["block", "stage", "bucket", "data"])

        for batch in batches:
            for block, bucket, data in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if bucket not in held:
                    for full in list(held):  # rows come sorted by bucket
                        yield done(full)
                held.setdefault(bucket, []).append((block, data))
        for full in list(held):
            yield done(full)

    spark = parts.sparkSession
    n = partitions(spark)
    known = spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels(spark, n))], "slot int, to int")  # one row a partition
    rows = parts.select("block", F.explode("parts").alias("p")).select("block", "p.bucket", "p.data", F.pmod("p.bucket", F.lit(n)).cast("int").alias("slot"))
    dealt = rows.join(F.broadcast(known), "slot").select("block", "bucket", "data", "to")
    return dealt.repartition("to").sortWithinPartitions("bucket", "block").select("block", "bucket", "data").mapInArrow(tidy(run), "block long, stage int, bucket int, data binary")


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The stored blocks, each with its answers; the blocks stay where they are."""
    grouped = answers.groupBy("block").agg(F.collect_list(F.struct("stage", "bucket", "data")).alias("answers"))
    return blocks.select("block", "texts").join(grouped.hint("merge"), "block", "left")


def per_block(joined: DataFrame, f: Callable[[int, np.ndarray, list[bytes], dict[int, dict[int, bytes]]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies f(block, ids, texts, answers by stage and bucket) to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got: dict[int, dict[int, bytes]] = {}
                for a in batch.column("answers")[i].as_py() or []:
                    got.setdefault(a["stage"], {})[a["bucket"]] = a["data"]
                ids, texts = unpack_texts(batch.column("texts")[i].as_py())
                if (out := f(batch.column("block")[i].as_py(), ids, texts, got)) is not None:
                    yield out

    return joined.mapInArrow(tidy(run), schema)


def parts_row(block: int, parts: Parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([parts], _PART)], ["block", "parts"])


# ------------------------------------------------------------------ shared keys


def key_bytes(keys: np.ndarray) -> bytes:
    """40 bits of each key; with the bits that chose the bucket they only make rare false alarms, which are checked later."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def key_parts(keys: np.ndarray, owner: np.ndarray, buckets: int) -> Parts:
    """Distinct keys of a block by bucket, with a bit for those that two different documents of the block have."""
    order = np.lexsort((owner, keys))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(k)) - 1
    k, several = k[first], o[first] != o[last] if len(k) else np.zeros(0, dtype=bool)
    return [{"bucket": b, "data": struct.pack("<q", len(at)) + np.packbits(several[at]).tobytes() + key_bytes(k[at])} for b, at in deal((k % np.uint64(buckets)).astype(np.int64), buckets)]


def shared_keys(parts: list[bytes]) -> list[bytes]:
    """For each part the bits of keys that another block, or two documents of its own, have too."""
    sizes = [struct.unpack_from("<q", p)[0] for p in parts]
    keys = np.zeros((sum(sizes), 8), dtype=np.uint8)
    several = np.zeros(sum(sizes), dtype=bool)
    at = 0
    for p, n in zip(parts, sizes, strict=True):
        bits = (n + 7) // 8
        several[at : at + n] = np.unpackbits(np.frombuffer(p, np.uint8, bits, 8), count=n)
        keys[at : at + n, 3:] = np.frombuffer(p, np.uint8, 5 * n, 8 + bits).reshape(n, 5)
        at += n
    k = keys.view("<u8").ravel()
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = s[1:] == s[:-1]
    shared = several
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    return [np.packbits(shared[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]


def read_shared(keys: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """For each key of the block whether it is shared."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), dtype=bool)
    for b, at in deal((distinct % np.uint64(buckets)).astype(np.int64), buckets):
        if b in answers:
            out[at] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(at))
    return out[inverse]


def smaller_elsewhere(parts: list[bytes]) -> list[bytes]:
    """For each part the bits of windows that a document with a smaller id than the block's smallest has."""
    got = [arrays(p) for p in parts]
    a, b, owner = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(a), dtype=bool)
    out[order] = least < owner[order]
    ends = np.cumsum([len(g[0]) for g in got])
    return [np.packbits(out[e - len(g[0]) : e]).tobytes() for e, g in zip(ends.tolist(), got, strict=True)]
