"""Vector functions in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|); null for a zero vector."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def normalise(v: Column) -> Column:
    """v at unit length; its length is worked out once a vector. A zero vector has none (nulls)."""
    return let(F.struct(v.alias("v"), F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)).alias("size")), lambda s: F.transform(s["v"], lambda x: (x / s["size"]).cast("float")))
