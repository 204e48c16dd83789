"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, calibrated probabilities.

Tokens are hashed: each word gives itself and its shape (letters by case, digits, runs collapsed; a word that repeats the
one before it has a shape of its own).  Random indexing gives
each hash bucket the sum, over its occurrences, of the sparse ternary index vectors of the tokens around it.  A document is
the mean of its tokens' vectors, drawn towards the mean document as if that had added some tokens, so that a few words
don't decide.  A network with one hidden layer is trained on those; a temperature fitted on a part of
the training rows that the weights never saw turns its margin into a probability.

Only the text enters a score.  The vectors count the words of all documents, labelled or not.  The fit of the network and the
temperature uses at most `FIT_ROWS` labelled documents (half of each label, the first by a hash of the id); scoring covers
every document and its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, Words, batches_of, documents, materialise, mix, numbered_columns, pick, tidy, utf8

FIT_ROWS = 4000
BUCKETS, DIM, NONZERO, AROUND, HIDDEN = 1 << 13, 48, 4, 2, 24
THRESHOLD = 0.7

#: Tokens that the mean document adds to each text's words and shapes.
PRIOR_WORDS, PRIOR_SHAPES = 24, 6
#: Slices of the count matrices that are added up apart, and tasks whose slices are added up first.
SLICES, FAN = 16, 32
_SUMS = "task int, slice int, sums binary"
_REPEAT = 0x5E1F

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_CLASS[SEPARATOR] = 32


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector."""
    r = np.random.default_rng(7)
    return r.integers(0, DIM, (BUCKETS, NONZERO)), r.choice(np.array([-1.0, 1.0], dtype=np.float32), (BUCKETS, NONZERO))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, buckets of shapes, and the number of words of each text."""
    w = Words(texts)
    kind = _CLASS[w.data]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 32)
    upto = np.concatenate(([0], np.cumsum(keep)))
    short, start, end = kind[keep], upto[w.start], upto[w.end]
    code = np.zeros(len(start), dtype=np.uint64)
    for k in range(8):  # a shape's first eight runs, and its length
        code = code * np.uint64(257) + np.where(start + k < end, short[np.minimum(start + k, max(len(short) - 1, 0))].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(short) else code
    code = mix(code ^ (np.minimum(end - start, 9).astype(np.uint64) << np.uint64(58)))
    again = np.zeros(len(code), dtype=bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[w.count > 0]] = False
    code[again] = np.uint64(_REPEAT)
    return (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), (code & np.uint64(BUCKETS - 1)).astype(np.int64), w.count


def _around(buckets: np.ndarray, count: np.ndarray, place: np.ndarray, sign: np.ndarray, into: np.ndarray) -> None:
    """Adds to `into` (flat, BUCKETS * DIM) the index vectors of each token's neighbours within its text, itself included."""
    text = np.repeat(np.arange(len(count)), count)
    for off in range(-AROUND, AROUND + 1):
        a, b = (buckets[-off:], buckets[:off]) if off < 0 else (buckets[: len(buckets) - off], buckets[off:])
        ta, tb = (text[-off:], text[:off]) if off < 0 else (text[: len(text) - off], text[off:])
        same = ta == tb
        a, b = a[same] * DIM, b[same]
        for j in range(NONZERO):
            into += np.bincount(a + place[b, j], weights=sign[b, j], minlength=len(into))


@dataclass
class Model:
    word: np.ndarray  # BUCKETS x DIM
    shape: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pool(self, texts: list[bytes]) -> np.ndarray:
        return drawn(*pooled(texts, self.word, self.shape), self.prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def drawn(x: np.ndarray, count: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Pooled vectors with the prior's tokens added."""
    k = np.repeat([PRIOR_WORDS, PRIOR_SHAPES], DIM)
    n = count[:, None]
    return (x * n + prior * k) / (n + k)


def pooled(texts: list[bytes], word: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of each text's word vectors and shape vectors (zeros without words), and the numbers of words.

    Sums run in pieces of a text in double precision, so a text's value doesn't depend on those beside it.
    """
    words, shapes, count = tokens(texts)
    out = np.zeros((len(texts), 2 * DIM))
    start = np.cumsum(count) - count
    for i in np.flatnonzero(count):
        a, n = start[i], count[i]
        for b, table, at in ((words, word, 0), (shapes, shape, DIM)):
            total = np.zeros(DIM)
            for s in range(a, a + n, 4096):
                total += table[b[s : min(s + 4096, a + n)]].sum(axis=0)
            out[i, at : at + DIM] = total / n
    return out, count


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(n > 0, m / np.maximum(n, 1e-9), 0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _summed(rows: DataFrame, group: Column) -> DataFrame:
    """(task, slice, sums): the sums of the rows of each group and slice, added up one by one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for task, part, data in zip(*(batch.column(c).to_pylist() for c in ("task", "slice", "sums")), strict=True):
                m = np.frombuffer(zlib.decompress(data), "<i8")
                if (task, part) == now:
                    total += m
                else:
                    if now:
                        yield _slice(*now, total)
                    now, total = (task, part), m.copy()
        if now:
            yield _slice(*now, total)

    return rows.withColumn("task", group.cast("int")).repartition("task", "slice").sortWithinPartitions("task", "slice").mapInArrow(tidy(add), _SUMS)


def _slice(task: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(sums.astype("<i8").tobytes(), 1)], pa.binary())], ["task", "slice", "sums"])


def vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Random-indexing vectors from all documents: a pair of count matrices a task, in slices, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index_vectors()
        sums = np.zeros((2, BUCKETS * DIM))
        for batch in batches:
            for part in batches_of(batch, "text", 4 << 20):
                words, shapes, count = tokens(utf8(part.column("text")))
                for m, b in zip(sums, (words, shapes), strict=True):
                    _around(b, count, place, sign, m)
        if sums.any():
            task = TaskContext.get().partitionId()
            for k, part in enumerate(sums.reshape(SLICES, -1)):
                yield _slice(task, k, part)

    rows = docs.select("text").mapInArrow(tidy(run), _SUMS)
    rows = _summed(_summed(rows, F.floor(F.col("task") / FAN)), F.lit(0)).collect()  # SLICES rows, two matrices of fixed size in all
    total = np.zeros((SLICES, 2 * BUCKETS * DIM // SLICES))
    for r in rows:
        total[r["slice"]] = np.frombuffer(zlib.decompress(r["sums"]), "<i8")
    total = total.reshape(2, BUCKETS, DIM)
    return _unit(total[0]).astype(np.float32), _unit(total[1]).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple:
    """Full-batch Adam on the logistic loss with weight decay; both labels weigh the same."""
    r = np.random.default_rng(11)
    p = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = weight * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y)
        back = np.outer(g, p[2]) * (1 - h * h)
        for k, slope in enumerate((x.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], g.sum())):
            m[k], v[k] = 0.9 * m[k] + 0.1 * slope, 0.99 * v[k] + 0.01 * slope * slope
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | float:
    """The model; or a constant score where the rows to learn from lack one of the labels."""
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = known.withColumn("o", F.xxhash64("doc_id"))
    sample = None
    for q in (0, 1):
        part = order.where(F.col("quality") == q).orderBy("o", "doc_id").limit(rows // 2)
        sample = part if sample is None else sample.unionByName(part)
    chosen = materialise(documents(docs).join(F.broadcast(sample.select("doc_id", "quality")), "doc_id").dropDuplicates(["doc_id"]), "quality-sample")  # at most `rows` ids
    counts = {r["quality"]: r["count"] for r in chosen.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    word, shape = vectors(documents(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                x, n = pooled(utf8(part.column("text")), word, shape)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(n), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())], ["doc_id", "quality", "n", "x"])

    got = sorted(chosen.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(tidy(run), "doc_id long, quality int, n long, x binary").collect())  # at most `rows` short rows
    x, y = np.array([np.frombuffer(r["x"], "<f8") for r in got]), np.array([r["quality"] for r in got], dtype=float)
    n = np.array([r["n"] for r in got])
    prior = x[n > 0].mean(axis=0) if (n > 0).any() else np.zeros(x.shape[1])
    x = drawn(x, n, prior)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    apart = np.arange(len(y)) % 5 == 0  # for the temperature
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart[:] = False
    w1, b1, w2, b2 = _train(z[~apart], y[~apart])
    check = apart if apart.any() else ~apart
    margin = np.tanh(z[check] @ w1 + b1) @ w2 + b2
    loss = lambda t: float(np.logaddexp(0, -np.where(y[check] == 1, margin, -margin) / t).mean())
    temperature = min(np.geomspace(0.25, 20, 80).tolist(), key=loss)
    return Model(word, shape, prior, mean, scale, w1, b1, w2, b2, temperature)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """The documents' (doc_id, score); an empty text is scored as the mean document."""
    d = documents(docs)
    if isinstance(model, float):
        return d.select("doc_id", F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: two tables of BUCKETS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.score(m.pool(utf8(part.column("text")))))], ["doc_id", "score"])

    return d.mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns, whatever their names.  An empty table stays empty;
    null texts are scored as empty ones."""
    model = fit(docs, labels)
    if isinstance(model, float):
        return docs if model >= THRESHOLD else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = numbered_columns(docs)
    text = at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in batches_of(batch, text, 1 << 20):
                good = m.score(m.pool([t or b"" for t in utf8(part.column(text))])) >= THRESHOLD
                if good.any():
                    yield part.filter(pa.array(good))

    return rows.mapInArrow(tidy(run), rows.schema).toDF(*docs.columns)


__all__ = ["Model", "classify", "fit", "held_out", "keep_good", "score", "tokens"]
