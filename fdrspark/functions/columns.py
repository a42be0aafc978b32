"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(eta: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-c(eta)))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(c(x), F.lit(high)), F.lit(low))


def finite(x: Column | str) -> Column:
    x = c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def present(x: Column | str) -> Column:
    """Missing values (null, NaN) as 0."""
    return F.coalesce(F.nanvl(c(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def r6(x: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(c(x), 6) + F.lit(0.0)


def sent(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has no more than ``most`` rows, which are counted first; so long tables stay where they are."""
    return F.broadcast(df) if len(df.columns) <= 3 and df.limit(most + 1).count() <= most else df


def with_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(one))
