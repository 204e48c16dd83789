"""What the training-data operators share: column picking, scratch tables, byte blocks and word hashes.

Conventions that hold for every operator here unless its docstring says otherwise:

* a null text counts as the empty text, and an empty table gives an empty result of the same schema;
* columns are picked by exact name and position, so extra columns, even with clashing names, are ignored;
* a null ``doc_id`` is carried through as null; where ids are compared it counts as the smallest;
* repeated rows each keep their row in the result.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete

#: Stands for a null doc_id inside a job.
NULL_ID = -(1 << 63)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name; the first one where a name occurs twice."""
    plain, at = numbered_columns(df)
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"no column {missing[0]!r} among {df.columns}")
    return plain.select(*[F.col(at[n]).alias(n) for n in names])


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns _c0, _c1, ..., and the number that stands for each name (the first, where it occurs twice): an
    operator's own columns then can't clash with a table's, whatever these are called."""
    names = df.columns
    at: dict[str, str] = {}
    for i, name in enumerate(names):
        at.setdefault(name, f"_c{i}")
    return df.toDF(*[f"_c{i}" for i in range(len(names))]), at


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), null texts as empty ones."""
    d = pick(docs, "doc_id", "text")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a session on one machine takes one in
    its warehouse; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths and tables that this process has written for its own use, in order.
CREATED: list[tuple[str, str]] = []


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what was written since CREATED had `since` entries, but for the last `keep`.  Results that still have to read
    from there must be written before."""
    gone = CREATED[since : len(CREATED) - keep]
    del CREATED[since : len(CREATED) - keep]
    for kind, name in gone:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            delete(spark, name)


#: Of long values: bytes of an Arrow batch, rows that a Parquet reader decodes at once, bytes of a row group (compressed) and of its pages.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20, "spark.sql.parquet.columnarReaderBatchSize": 256}
SMALL_GROUPS = {"parquet.block.size": 2 << 20, "parquet.page.size": 256 << 10}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile holds few long values at once in the JVM: Spark's defaults are numbers of rows, whatever their length."""
    held = {k: spark.conf.get(k) for k in SMALL_BATCHES}
    try:
        for k, v in SMALL_BATCHES.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes a frame as Parquet into the shared folder and reads it again: recovery starts from there.  Columns are written under
    numbers, so that any names will do.  small: for long values, in small batches and row groups."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    plain, _ = numbered_columns(df)
    with small_batches(spark) if small else contextlib.nullcontext():
        plain.write.options(**SMALL_GROUPS if small else {}).parquet(path)
    CREATED.append(("path", path))
    back = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    WHERE[id(back)] = path
    weakref.finalize(back, WHERE.pop, id(back), None)
    return back


#: Where the frames that materialise gave back are kept.
WHERE: dict[int, str] = {}


def forget(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Deletes what was written since CREATED had `since` entries, but for the tables of `kept` (as materialise gave them)."""
    stay = {WHERE[id(f)] for f in kept}
    gone = [c for c in CREATED[since:] if c[1] not in stay]
    CREATED[since:] = [c for c in CREATED[since:] if c[1] in stay]
    for kind, name in gone:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            delete(spark, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, whose worker gives memory that it has freed back to the system when a task ends: Spark keeps idle workers,
    and what they hold lessens what a later stage in the JVM can have."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return tidied


def batches_of(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch whose texts have at most most_bytes bytes (one longer row stands alone)."""
    lengths = np.asarray(pyarrow.compute.binary_length(batch.column(column)).fill_null(0))
    if not len(lengths):
        return
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each text."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NULL_ID), dtype=np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    """doc_ids with the sentinel turned into null again."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


# ---------------------------------------------------------------- removed spans

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def runs_of(gone: np.ndarray) -> list[dict[str, int]]:
    """The runs of true values, as starts and ends."""
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist() if gone.any() else []
    return [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def removed(spans: str) -> Column:
    """n_removed: the total length of an array of spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed")


# ---------------------------------------------------------------- word hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE, _BASE_W, _BASE_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Separators of words: 0x20 and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        known = tuple(np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, dtype=np.uint64)))) for b in (base, inverse))
        if size <= 1 << 20:  # larger ones go again
            _POWERS[int(base)] = known
    return known[0][:n], known[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of several texts: start, end (byte offsets in data), doc (index of the text), hash."""

    def __init__(self, texts: list[bytes], lower: bool = False, hashes: bool = True) -> None:
        self.data = data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        inside = ~SEPARATOR[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(data) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]  # every text is followed by a separator
        self.first = np.searchsorted(self.start, self.text_start)  # of each text
        self.count = np.diff(np.append(self.first, len(self.start)))
        if hashes:
            table = _BYTE_LOWER if lower else _BYTE
            self.hash = np.empty(len(self.start), dtype=np.uint64)
            step = 1 << 15  # words at a time, so that the arrays stay in the cache
            for a in range(0, len(self.start), step):
                s, e = self.start[a : a + step], self.end[a : a + step]
                lo, hi = int(s[0]), int(e[-1])
                up, down = powers(_BASE, hi - lo + 1)
                sums = np.zeros(hi - lo + 1, dtype=np.uint64)
                np.cumsum(table[data[lo:hi]] * up[:-1], out=sums[1:])
                self.hash[a : a + step] = mix((sums[e - lo] - sums[s - lo]) * down[s - lo])


def grams(hashes: np.ndarray, n: int, check: bool = False) -> np.ndarray:
    """A hash of each n successive values (they may cross texts); check: by a second, independent polynomial."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(_BASE_C if check else _BASE_W, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum((mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if check else hashes) * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])
