"""Null columns that are never made: only their coordinates along a growing orthonormal basis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.functions.rng import normal, sphere


def pool(spark: SparkSession, experiments: int, dummies: int) -> DataFrame:
    """(k, d): the dummies of all experiments."""
    return spark.range(experiments).select(F.col("id").cast("int").alias("k")).crossJoin(spark.range(dummies).select(F.col("id").cast("int").alias("d")))


def coordinate(stick: Column, n: int, m: int, seed: int, spherical: bool = True) -> Column:
    """The coordinate of dummy (k, d) along basis vector m, given what is left of its squared length.

    Spherical dummies are uniform on the unit sphere of centred vectors, which has
    n - 1 dimensions, so that n - m - 2 remain besides this one; Gaussian ones have
    independent coordinates of variance 1/n.
    """
    key = (seed, F.col("k"), F.col("d"), m)
    if spherical:
        return F.sqrt(stick) * sphere(float(n - m - 2), *key)
    return normal(*key) / F.sqrt(F.lit(float(n)))


def first_row(pool: DataFrame, n: int, seed: int, spherical: bool = True) -> DataFrame:
    """(k, d, a0, stick): coordinates along the response."""
    a = coordinate(F.lit(1.0), n, 0, seed, spherical)
    return pool.withColumn("a0", a).withColumn("stick", F.greatest(1.0 - F.col("a0") * F.col("a0"), F.lit(0.0)) if spherical else F.lit(1.0))


def extend(pool: DataFrame, n: int, m: int, seed: int, spherical: bool = True, eps: float = 1e-12) -> DataFrame:
    """pool with coordinate a<m>; dummies that have used up their length get 0."""
    a = F.when(F.col("stick") > eps, coordinate(F.col("stick"), n, m, seed, spherical)).otherwise(0.0)
    out = pool.withColumn(f"a{m}", a)
    return out.withColumn("stick", F.greatest(F.col("stick") - F.col(f"a{m}") * F.col(f"a{m}"), F.lit(0.0))) if spherical else out
