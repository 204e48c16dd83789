"""Near-duplicates: MinHash bands for candidates, odd sketches to verify them, full shingle sets to confirm.

1. Each document gets its shingle set, MinHash samples, band keys, and an odd sketch: the samples folded into a bitmap of
   parities, whose XOR with another one has a population count that estimates high similarities well.
2. Documents with the same set become one class (a partial aggregate), so copies cost nothing further.
3. In each band bucket, sketches are compared in blocks of bounded size; only what connects them is kept, at most one link
   a member.  Their components are the families.
4. In each family, in blocks again, on sets of shingles made once, exact intersection sizes of the full sets are products of incidence matrices; again
   only what connects is kept.  The components of these links are the result.

No step holds an unbounded group in one task, drops a member of a large bucket, or writes all pairs of a group.  Bands of
5 rows, 25 of them, miss a pair at similarity 0.85 with probability 4e-7 (5e-5 at 0.8), and less above; the sketches drop one of
a thousand million pairs at the asked similarity (`furthest` computes the bound), and what they let through is confirmed exactly.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CREATED, NULL_ID, Words, batches_of, documents, forget, grams, ids_of, materialise, mix, numbered_columns, partitions, tidy, utf8
from .components import components

ROWS, BANDS = 5, 25
SAMPLES = ROWS * BANDS
SKETCH_BITS = 256
#: Members of a block of a bucket and of a family, and bytes of the latter's sets.
BLOCK, FAMILY, BLOCK_BYTES = 512, 256, 4 << 20
#: The share of pairs at the asked similarity that the sketches may drop, far below what the bands miss.
MISS = 1e-9
_RNG = np.random.default_rng(20121)
_A = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_SALT = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: `size` words in lower case; all words where there are fewer."""
    w = Words(texts, lower=True)
    g = grams(w.hash, size)
    out = []
    for first, count in zip(w.first.tolist(), w.count.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(g[first : first + count - size + 1]))
        elif count:
            out.append(mix(grams(w.hash[first : first + count], count) + np.uint64(count)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch (as 64-bit words) of a set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 512):
        least = np.minimum(least, (s[a : a + 512, None] * _A).min(axis=0))
    least >>= np.uint64(20)
    key = np.zeros(BANDS, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for col in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(31) + col)
    bit = (mix(least ^ _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return key.view(np.int64), np.packbits(odd, bitorder="little").view(np.int64)


@functools.cache
def furthest(percent: int, miss: float = MISS) -> int:
    """The XOR count of two sketches that a pair of similarity percent / 100 or more passes with probability below `miss`.

    Exact, for ideal hashes: the samples that differ are binomial, each flips one bit on either side, and the number of odd bits
    after so many flips is a Markov chain.
    """
    apart = 1 - percent / 100
    odd = np.zeros(SKETCH_BITS + 1)
    odd[0] = 1.0
    up, down = 1 - np.arange(SKETCH_BITS + 1) / SKETCH_BITS, np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    total = np.zeros(SKETCH_BITS + 1)
    for d in range(SAMPLES + 1):
        total += math.comb(SAMPLES, d) * apart**d * (1 - apart) ** (SAMPLES - d) * odd
        for _ in range(2):
            odd = np.concatenate(([0.0], (odd * up)[:-1])) + np.concatenate(((odd * down)[1:], [0.0]))
    beyond = np.cumsum(total[::-1])[::-1]  # P(count >= c)
    return int(np.argmax(beyond <= miss)) - 1 if apart else 0


def _connect(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest index that it can reach."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; shingles of one set only can't count, the others go through products of 0-1 matrices."""
    n = len(sets)
    ids, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    row, col = owner[use], column[inverse[use]]
    out = np.zeros((n, n), dtype=np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = max(256, (1 << 23) // max(n, 1))
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(col, [a, a + step])
        x = np.zeros((n, step), dtype=np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each run of equal keys, as lists by column."""
    held: dict[str, list] | None = None
    now: tuple | None = None
    for batch in batches:
        cols = {f.name: batch.column(i).to_pylist() for i, f in enumerate(batch.schema)}
        for i, key in enumerate(zip(*(cols[k] for k in keys), strict=True)):
            if key != now:
                if held:
                    yield held
                held, now = {c: [] for c in cols}, key
            for c, v in cols.items():
                held[c].append(v[i])
    if held:
        yield held


_LINKS = ["a", "b"]


def _links(ids: list[int], linked: np.ndarray) -> pa.RecordBatch | None:
    label = _connect(linked)
    at = np.flatnonzero(label != np.arange(len(label)))
    if not len(at):
        return None
    x = np.array(ids, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(x[label[at]])], _LINKS)


def _blocked(rows: DataFrame, key: str, blocks: str, id_col: str) -> DataFrame:
    """Deals the members of each key into `blocks` blocks and sends each pair of blocks to a group of its own (_i, _j).  The number
    of partitions is given, as the work of a group is far more than its bytes tell."""
    mine = F.pmod(F.xxhash64(id_col), F.col(blocks)).cast("int")
    df = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return df.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other")).repartition(partitions(rows.sparkSession), key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


#: A bitmap of the texts that families need, as rows of 64 bits: bounded, whatever the corpus.
MARK_BITS = 18


def _marked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose text_hash may be among the chosen: a bitmap of 2**MARK_BITS words, built by a partial aggregate and broadcast
    (at most so many rows).  False alarms are met by the join after it; a full bitmap lets everything through."""
    word, bit = F.shiftrightunsigned("text_hash", 64 - MARK_BITS), F.shiftrightunsigned("text_hash", 58 - MARK_BITS).bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marks = materialise(chosen.select(word.alias("_word"), one.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "marks")
    return rows.withColumn("_word", word).join(F.broadcast(marks), "_word").where(F.col("_bits").bitwiseAND(one) != 0).drop("_word", "_bits")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Links join documents whose shingle sets (of `size` words, A-Z lower-cased) have 100 * intersection >= percent * union.
    Texts without words are linked with nothing and stand alone.  Rows that repeat a doc_id are one node: what either of their
    texts is linked with belongs together; all rows of the smallest are kept.  Rows without a doc_id are nodes of their own;
    they count as the smallest, so the component of such a row is null, and they are kept.
    """
    spark = docs.sparkSession
    far, begun = furthest(percent), len(CREATED)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                n, key, bands, sketch = [], [], [], []
                for s in shingle_sets(utf8(part.column("text")), size):
                    n.append(len(s))
                    key.append(np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)]).tobytes())
                    b, o = signature(s) if len(s) else (None, None)
                    bands.append(b)
                    sketch.append(o)
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(part.column("doc_id"))), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "set_key", "bands", "sketch"])

    def weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, ["key", "_i", "_j"]):
            s, n = np.array(g["sketch"], dtype=np.int64).view(np.uint64), np.array(g["n"], dtype=np.int64)
            apart = np.zeros((len(n), len(n)), dtype=np.int64)
            for w in range(s.shape[1]):
                apart += np.bitwise_count(s[:, None, w] ^ s[None, :, w])
            small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
            if (out := _links(g["node"], (apart <= far) & (100 * small >= percent * large))) is not None:
                yield out

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                sets = [s.tobytes() for s in shingle_sets(utf8(part.column("text")), size)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("root"), pa.array(sets, pa.binary())], ["node", "root", "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, ["root", "_i", "_j"]):
            sets = [np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            both = _intersections(sets)
            if (out := _links(g["node"], 100 * both >= percent * (n[:, None] + n - both))) is not None:
                yield out

    texts = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    signed = materialise(texts.mapInArrow(tidy(sign), "doc_id long, text_hash long, n long, set_key binary, bands array<long>, sketch array<long>"), "signatures")
    some = signed.where("n > 0")
    first = some.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "text_hash", "n", "bands", "sketch"), "doc_id").alias("s"))
    classes = materialise(first.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("s.doc_id").alias("rep"), "s.text_hash", "s.n", "s.bands", "s.sketch"), "classes")

    banded = classes.select("node", "n", "sketch", F.explode("bands").alias("key"))
    buckets = materialise(classes.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    families = components(_blocked(banded.join(buckets, "key"), "key", "blocks", "node").select("key", "_i", "_j", "node", "n", "sketch").mapInArrow(tidy(weak), "a long, b long"))

    chosen = materialise(classes.select("node", F.col("rep").alias("doc_id"), "text_hash").join(families, "node"), "chosen")
    found = _marked(texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))), chosen).dropDuplicates(["doc_id", "text_hash"])
    members = materialise(found.join(chosen, ["doc_id", "text_hash"]).select("node", "root", "text").mapInArrow(tidy(shingled), "node long, root long, shingles binary"), "members")
    shape = materialise(members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / FAMILY, F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int").alias("blocks")), "families")
    links = _blocked(members.join(shape, "root"), "root", "blocks", "node").select("root", "_i", "_j", "node", "shingles").mapInArrow(tidy(confirm), "a long, b long")

    # texts that one doc_id stands for
    several = some.where(F.col("doc_id") != NULL_ID).groupBy("doc_id").agg(F.min("set_key").alias("first_key"), F.max("set_key").alias("last_key")).where("first_key <> last_key").drop("last_key")
    tied = some.select("doc_id", "set_key").join(several, "doc_id").where("set_key <> first_key").select("set_key", "first_key").distinct()
    keys = classes.select("set_key", "node")
    ties = tied.join(keys, "set_key").select(F.col("node").alias("a"), "first_key").join(keys.toDF("first_key", "b"), "first_key").select("a", "b")
    roots = components(links.unionByName(ties))

    linked = materialise(classes.select("node", "rep").join(roots, "node"), "linked")
    least = materialise(linked.groupBy("root").agg(F.min("rep").alias("component")), "least")
    named = linked.join(least, "root").select("node", "component")
    resolved = materialise(classes.select("set_key", "node", "rep").join(named, "node", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "components")
    forget(spark, begun, signed, resolved)
    out = signed.select("doc_id", "n", "set_key").join(resolved, "set_key", "left")
    real = lambda c: F.when(c != NULL_ID, c)
    component = F.coalesce("component", "doc_id")
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one per group stays (the one with the smallest doc_id; all of its rows), with all their columns,
    whatever their names."""
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows, at = numbered_columns(docs)
    return rows.join(kept, F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_kept")), "left_semi").toDF(*docs.columns)
