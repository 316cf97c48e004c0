"""Vector and ranking functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision; lower is nearer. Vectors aren't normalised."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank.cast("double") + 1)


def rrf_term(rank: Column, k: float, weight: Column) -> Column:
    return weight / (F.lit(float(k)) + rank)


def found_by(dense_rank: Column, sparse_rank: Column) -> Column:
    return F.when(dense_rank.isNotNull() & sparse_rank.isNotNull(), "both").when(dense_rank.isNotNull(), "dense").when(sparse_rank.isNotNull(), "bm25").otherwise("neither")
