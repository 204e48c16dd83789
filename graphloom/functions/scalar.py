"""Scalar functions of the query language over Columns, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_distance(a: Column, b: Column, metric: str = "L2") -> Column:
    """Euclidean distance of two float vectors; null if either is null."""
    if metric.upper() not in ("L2", "EUCLIDEAN"):
        raise ValueError(f"metric {metric} isn't supported")
    return F.sqrt(squared_distance(a, b)).cast("float")


def squared_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)


def nullif(a: Column, b: Column) -> Column:
    return F.when(a == b, None).otherwise(a)


def all_different(*items: Column) -> Column:
    out = F.lit(True)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            out = out & (a != b)
    return out


def same(first: Column, *rest: Column) -> Column:
    out = F.lit(True)
    for b in rest:
        out = out & (first == b)
    return out


#: Names of the language that differ from Spark's; any other name is looked up among Spark's functions.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "CHAR_LENGTH": F.char_length,
    "CHARACTER_LENGTH": F.char_length,
    "BYTE_LENGTH": F.octet_length,
    "OCTET_LENGTH": F.octet_length,
    "ABS": F.abs,
    "COALESCE": F.coalesce,
    "NULLIF": nullif,
    "SIZE": F.size,
    "CARDINALITY": F.size,
    "MOD": lambda a, b: a % b,
    "UPPER": F.upper,
    "LOWER": F.lower,
    "TRIM": F.trim,
    "ROUND": F.round,
    "CEIL": F.ceil,
    "CEILING": F.ceil,
    "FLOOR": F.floor,
    "POWER": F.pow,
    "SQRT": F.sqrt,
    "LEFT": lambda s, n: F.left(s, n),
    "RIGHT": lambda s, n: F.right(s, n),
    "SUBSTRING": lambda s, a, n=None: s.substr(a, n if n is not None else F.length(s)),
    "DURATION_BETWEEN": lambda a, b: b - a,
    "DATE": lambda s: F.to_date(s),
    "LOCAL_DATETIME": lambda s: F.to_timestamp_ntz(s),
    "TOSTRING": lambda a: a.cast("string"),
    "TOINTEGER": lambda a: a.try_cast("long"),
    "TOFLOAT": lambda a: a.try_cast("double"),
}


def register(name: str, f: Callable[..., Column]) -> None:
    """Adds a function of Columns (a Spark expression or a vectorised UDF) to the language."""
    FUNCTIONS[name.upper()] = f


def call(name: str, args: list[Column]) -> Column:
    f = FUNCTIONS.get(name.upper())
    return f(*args) if f else F.call_function(name.lower(), *args)
