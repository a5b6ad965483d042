"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Divided by its length; zero stays zero."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (an array of arrays) whose mask is 1, component by component; without any: zeros."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    length = F.coalesce(F.size(F.get(vectors, F.lit(0))), F.lit(0))
    total = lambda i: F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double"))
    places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: total(i) / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
