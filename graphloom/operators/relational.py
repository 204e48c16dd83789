"""Joins, factorised operators and sorting as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on which nulls match nulls; left columns first.  Without keys it is the product of both sides."""
    if not keys:
        return left.crossJoin(right)
    on = None
    for a, b in keys:
        c = left[a].eqNullSafe(right[b])
        on = c if on is None else on & c
    return left.join(right, on, how)


def factorize(rows: DataFrame, keys: list[str], nested: str) -> DataFrame:
    """One row per key with the other columns as an array of structs (a factorised expansion)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(nested))


def multiplicities(branches: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, n): the size of the product of the branches' rows for each key.  Every branch is counted by key first (a partial
    aggregate), so no key's rows ever meet in one place."""
    out = None
    for i, b in enumerate(branches):
        one = b.groupBy(*keys).agg(F.count("*").alias(f"_n{i}"))
        out = one if out is None else out.join(one, keys)
    n = F.lit(1).cast("long")
    for i in range(len(branches)):
        n = n * F.col(f"_n{i}")
    return out.select(*keys, n.alias("n"))


def aggregate_product(kind: str, keys: list[str], others: list[DataFrame], over: DataFrame | None = None, value: Column | None = None) -> DataFrame:
    """COUNT, SUM, AVG, MIN or MAX over the product of branches that share keys, without building it: each branch is reduced to
    one row a key, rows of keys are joined, and values count as often as the other branches say."""
    if over is None:
        return multiplicities(others, keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"))
    parts = over.groupBy(*keys).agg(F.count(value).alias("_c"), F.sum(value.cast("double")).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    both = parts.join(multiplicities(others, keys), keys) if others else parts.withColumn("n", F.lit(1).cast("long"))
    c, s = F.sum(F.col("_c") * F.col("n")), F.sum(F.col("_s") * F.col("n"))
    agg = {"COUNT": F.coalesce(c, F.lit(0)).cast("long"), "SUM": F.when(c > 0, s), "AVG": s / F.nullif(c, F.lit(0)), "MIN": F.min("_lo"), "MAX": F.max("_hi")}[kind]
    return both.agg(agg.alias(kind.lower()))


def flatten(rows: DataFrame, nested: str) -> DataFrame:
    """The inverse of factorize."""
    others = [F.col(c) for c in rows.columns if c != nested]
    return rows.select(*others, F.explode(nested).alias("_x")).select(*others, "_x.*")


def factorized_filter(rows: DataFrame, nested: str, keep: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn(nested, F.filter(nested, keep))


def factorized_project(rows: DataFrame, nested: str, value: Callable[[Column], Column], out: str) -> DataFrame:
    return rows.withColumn(out, F.transform(nested, value))


def factorized_aggregate(rows: DataFrame, nested: list[str], kind: str, value: Callable[[Column], Column] | None = None, over: str | None = None, factor: str | None = None) -> DataFrame:
    """COUNT, SUM, AVG, MIN or MAX over the unnested product of the nested columns, without unnesting it.

    `value` is taken from the elements of the nested column `over`; the sizes of the other ones (and `factor`) are its
    multiplicity.
    """
    weight = F.col(factor).cast("long") if factor else F.lit(1).cast("long")
    for n in nested:
        if n != over:
            weight = weight * F.size(n).cast("long")
    if kind == "COUNT" and over is None:
        return rows.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("count"))
    values = F.filter(F.transform(over, value), lambda x: x.isNotNull())
    if kind in ("MIN", "MAX"):
        pick = {"MIN": F.array_min, "MAX": F.array_max}[kind](values)
        best = F.when(weight > 0, pick)
        return rows.agg((F.min if kind == "MIN" else F.max)(best).alias(kind.lower()))
    n = F.size(values).cast("long") * weight
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) * weight
    agg = {"COUNT": F.coalesce(F.sum(n), F.lit(0)).cast("long"), "SUM": F.when(F.sum(n) > 0, F.sum(total)), "AVG": F.sum(total) / F.nullif(F.sum(n), F.lit(0))}[kind]
    return rows.agg(agg.alias(kind.lower()))


def order_by(rows: DataFrame, keys: list[tuple[Column, bool, bool]]) -> DataFrame:
    """Sorts by (column, ascending, nulls first); nulls come last unless told otherwise."""
    return rows.orderBy(*[(c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()) for c, up, first in keys])
