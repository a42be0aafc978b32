"""One test per column: trend tests, marginal regression, and step-up procedures over their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.functions.columns import clip, sent, with_scalars
from fdrspark.functions.tails import normal_two_sided, t_two_sided_column
from fdrspark.session import once


def trend_test(dosages: DataFrame, cases: DataFrame, scaled: bool = True) -> DataFrame:
    """(j, z) of the Cochran-Armitage test for (row_id, j, g), absent genotypes being 0, and (row_id, y) with y 0 or 1.

    Three sums per column; they add up over any parts of the rows, so streams and
    batches share them. ``scaled`` as in ``trend_statistic``.
    """
    base = cases.agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("n1"))
    s = dosages.join(sent(cases), "row_id").groupBy("j").agg(F.sum("g").alias("sx"), F.sum(F.col("g") * F.col("g")).alias("sxx"), F.sum(F.col("g") * F.col("y")).alias("sxy"))
    return trend_statistic(with_scalars(s, base), scaled)


def trend_statistic(sums: DataFrame, scaled: bool = True) -> DataFrame:
    """(j, z) from sums; the variance of the textbook, or without its last division by n, which makes z the square root of n times smaller."""
    n, n1, sx = F.col("n"), F.col("n1"), F.col("sx")
    var = n1 * (n - n1) / (n * (n - 1)) * (n * F.col("sxx") - sx * sx)
    if scaled:
        var = var / n
    return sums.select("j", ((F.col("sxy") - n1 / n * sx) / F.sqrt(F.greatest(var, F.lit(1e-20)))).alias("z"))


def marginal_regression(long: DataFrame, response: DataFrame) -> DataFrame:
    """(j, r, t, df): correlation with the response and its t statistic; columns or responses that don't vary have r 0."""
    s = long.join(sent(response), "row_id").groupBy("j").agg(F.corr("x", "y").alias("r"), (F.count("*") - 2).alias("df"))
    r = clip(F.coalesce(F.nanvl(F.col("r"), F.lit(0.0)), F.lit(0.0)), -1 + 1e-10, 1 - 1e-10)
    return s.select("j", r.alias("r"), (r * F.sqrt(F.col("df") / (1 - r * r))).alias("t"), "df")


def regression_statistic(sums: DataFrame) -> DataFrame:
    """(j, r, t, df) of the marginal regression from sums (j, m, sx, sxx, sy, syy, sxy); a column whose length is next to nothing has r 0."""
    m = F.col("m")
    sxx, syy = F.col("sxx") - F.col("sx") * F.col("sx") / m, F.col("syy") - F.col("sy") * F.col("sy") / m
    raw = (F.col("sxy") - F.col("sx") * F.col("sy") / m) / F.sqrt(sxx * syy)
    r = F.when((sxx > 1e-20) & (syy > 1e-20), clip(raw, -1 + 1e-10, 1 - 1e-10)).otherwise(F.lit(0.0))
    d = sums.select("j", r.alias("r"), (m - 2).alias("df"))
    return d.select("j", "r", (F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r")))).alias("t"), "df")


def with_p(stats: DataFrame, z: str, df: str | None = None) -> DataFrame:
    """stats with the two-sided p of a column: by the normal law, or by t with the degrees of freedom in column ``df``."""
    return stats.withColumn("p", normal_two_sided(F.col(z)) if df is None else t_two_sided_column(F.col(z), F.col(df)))


def step_up(pvalues: DataFrame, alpha: float, dependent: bool = False) -> DataFrame:
    """pvalues (j, p, ...) with rank and reject by Benjamini-Hochberg, or Benjamini-Yekutieli if dependent.

    The threshold is one aggregate over ranks. Ranks come from a sort by range
    and the sizes of the partitions before, not from a window over all rows.
    """
    ranked = global_rank(pvalues, ["p", "j"])
    m = pvalues.agg(F.count("*").alias("m"))
    if dependent:
        h = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("m"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
        m = m.select("m", h.alias("h"))
    else:
        m = m.withColumn("h", F.lit(1.0))
    d = with_scalars(ranked, m)
    line = F.col("rank") * alpha / (F.col("m") * F.col("h"))
    cut = d.filter(F.col("p") <= line).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_k"))
    return with_scalars(d.drop("m", "h"), cut).withColumn("reject", F.col("rank") <= F.col("_k")).drop("_k")


def running_sums(df: DataFrame, by: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with sums of columns over all rows up to each one, itself included, in the order of by, which must tell all rows apart.

    A range partitioning sorts in parallel; a row per partition gives the offsets.
    """
    part = df.repartitionByRange(*[F.col(b) if isinstance(b, str) else b for b in by]).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = part.withColumns({f"_s_{k}": F.sum(c).over(w) for k, c in sums.items()})
    whole = part.groupBy("_part").agg(*[F.sum(c).alias(f"_w_{k}") for k, c in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    before = whole.select("_part", *[F.coalesce(F.sum(f"_w_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums])
    out = local.join(F.broadcast(before), "_part")
    return out.select(*df.columns, *[(F.col(f"_s_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def global_rank(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """df with rank 1, 2, ... in the order of by, which must tell all rows apart; no task sorts more than a range of it."""
    return running_sums(df, by, {"rank": F.lit(1).cast("long")})


def knockoff_threshold(w: DataFrame, q: float) -> DataFrame:
    """(threshold) of statistics (j, w): the least t among nonzero |w| with (1 + #(w <= -t)) / max(1, #(w >= t)) <= q; infinite if none."""
    t = w.filter("w <> 0").groupBy(F.abs("w").alias("t")).agg(F.sum((F.col("w") < 0).cast("long")).alias("neg"), F.sum((F.col("w") > 0).cast("long")).alias("pos"))
    counts = running_sums(t, [F.desc("t")], {"below": F.col("neg"), "above": F.col("pos")})
    ok = counts.filter((1 + F.col("below")) / F.greatest(F.col("above"), F.lit(1)) <= q)
    return ok.agg(F.coalesce(F.min("t"), F.lit(float("inf"))).alias("threshold"))


def knockoff_select(w: DataFrame, q: float) -> DataFrame:
    """w with ``selected``; the threshold is one of the |w|, so w is evaluated once for both."""
    w = once(w)
    return with_scalars(w, knockoff_threshold(w, q)).withColumn("selected", F.col("w") >= F.col("threshold"))


def screen(stats: DataFrame, k: int, by: str = "p") -> DataFrame:
    """The k columns of least p, in the order of j."""
    return stats.orderBy(by, "j").limit(k).orderBy("j")
