"""Summaries of results: order statistics, distribution distances, method tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.functions.columns import with_scalars
from fdrspark.functions.tails import normal_cdf, normal_quantile
from fdrspark.operators.marginal import global_rank


def order_statistics(values: DataFrame, m: int) -> DataFrame:
    """(group, rank, x): the m largest |x| of each group; a top-k, cut before the shuffle."""
    w = Window.partitionBy("grp").orderBy(F.desc(F.abs("x")), "id")
    return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m).select("grp", "rank", F.abs("x").alias("x"))


def ecdf(values: DataFrame) -> DataFrame:
    """(id, x, f): rank / count; values that are equal rank by id."""
    return with_scalars(global_rank(values, ["x", "id"]), values.agg(F.count("*").alias("_n"))).select("id", "x", (F.col("rank") / F.col("_n")).alias("f"))


def quantile_pairs(a: DataFrame, b: DataFrame, qs: list[float]) -> DataFrame:
    """(q, qa, qb): interpolated quantiles of x in both."""
    at = F.array(*map(F.lit, qs))
    pair = with_scalars(a.agg(F.percentile("x", at).alias("a")), b.agg(F.percentile("x", at).alias("b")))
    return pair.select(F.explode(F.arrays_zip(at.alias("q"), F.col("a").alias("qa"), F.col("b").alias("qb"))).alias("z")).select("z.q", "z.qa", "z.qb")


def ks_normal(values: DataFrame) -> DataFrame:
    """(n, ks): the greatest distance of the empirical distribution to the standard normal; null below 20 values."""
    r = with_scalars(global_rank(values, ["x", "id"]), values.agg(F.count("*").alias("n")))
    cdf = normal_cdf(F.col("x"))
    gap = F.greatest(F.col("rank") / F.col("n") - cdf, cdf - (F.col("rank") - 1) / F.col("n"))
    return r.agg(F.first("n").alias("n"), F.max(gap).alias("d")).select("n", F.when(F.col("n") >= 20, F.col("d")).alias("ks"))


def w1_normal(values: DataFrame) -> DataFrame:
    """(n, w1): the mean distance of sorted values to normal quantiles at (i - 1/2) / n."""

    r = with_scalars(global_rank(values, ["x", "id"]), values.agg(F.count("*").alias("n")))
    return r.select("n", F.abs(F.col("x") - normal_quantile((F.col("rank") - 0.5) / F.col("n"))).alias("d")).agg(F.first("n").alias("n"), F.avg("d").alias("w1"))


def bands(values: DataFrame, qs: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """(grp, mean, q0, q1, ...): mean and interpolated quantiles of x in each group, without NaN."""
    x = F.when(~F.isnan("x"), F.col("x"))
    q = F.percentile(x, F.array(*map(F.lit, qs)))
    return values.groupBy("grp").agg(F.avg(x).alias("mean"), q.alias("q")).select("grp", "mean", *[F.col("q")[i].alias(f"q{i}") for i in range(len(qs))])


def method_summary(results: DataFrame, alpha: float, slack: float = 0.005) -> DataFrame:
    """A row per method: runs, errors, mean and population deviation of fdp and tpp, other means, whether fdp is held."""
    ok = F.col("error").isNull()
    when = lambda c: F.when(ok, F.col(c))
    d = results.groupBy("method").agg(
        F.sum(ok.cast("long")).alias("n_runs"), F.sum((~ok).cast("long")).alias("n_errors"),
        F.avg(when("fdp")).alias("mean_fdp"), F.stddev_pop(when("fdp")).alias("std_fdp"), F.avg(when("tpp")).alias("mean_tpp"), F.stddev_pop(when("tpp")).alias("std_tpp"),
        F.avg(when("n_disc")).alias("mean_disc"), F.avg(when("runtime_s")).alias("mean_runtime_s"), F.avg(when("peak_rss_mb")).alias("mean_peak_rss_mb"),
    )
    return d.withColumn("fdr_controlled", F.col("mean_fdp") <= alpha + slack)


def per_run(results: DataFrame, methods: list[str], metrics: list[str]) -> DataFrame:
    """A row per run: n, p, then a column method_metric for each of both."""
    base = results.groupBy("run")
    n = base.agg(F.first("n", ignorenulls=True).alias("n"), F.first("p", ignorenulls=True).alias("p"))
    wide = base.pivot("method", methods).agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])
    if len(metrics) == 1:
        wide = wide.select("run", *[F.col(m).alias(f"{m}_{metrics[0]}") for m in methods])
    return n.join(wide, "run")


def noise_scale(signal: DataFrame, snr: float) -> DataFrame:
    """(sd, sd_by_norm): noise deviations for an SNR, from the signal's variance and from its norm."""
    return signal.agg(F.sqrt(F.var_pop("s") / snr).alias("sd"), (F.sqrt(F.sum(F.col("s") * F.col("s"))) / (snr * F.sqrt(F.count("*")))).alias("sd_by_norm"))


