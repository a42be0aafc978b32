"""The steps of forward selection as relational operators: correlations, winners, step lengths, tie sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.functions.columns import with_scalars
from fdrspark.operators.marginal import global_rank


def winner(corr: DataFrame) -> DataFrame:
    """The row of (kind, idx, c) that enters next: greatest |c|; ties go to dummies, then to the least index."""
    order = F.struct(F.abs("c").alias("a"), (F.col("kind") == "dummy").cast("int").alias("d"), (-F.col("idx")).alias("i"))
    return corr.agg(F.max_by(F.struct("kind", "idx", "c"), order).alias("w")).select("w.kind", "w.idx", "w.c")


def tie_set(corr: DataFrame, eps: float = 1e-12) -> DataFrame:
    """The rows of (j, c) whose |c| is within eps of the greatest."""
    return with_scalars(corr, corr.agg(F.max(F.abs("c")).alias("_m"))).filter(F.abs("c") >= F.col("_m") - eps).drop("_m")


def step_lengths(rows: DataFrame, C: str = "big_c", A: str = "big_a", tol: float = 1e-10) -> DataFrame:
    """rows (idx, c, a, C, A) with gamma: the least positive (C - c)/(A - a) and (C + c)/(A + a); null if there is none."""
    def one(num, den):
        t = F.when(F.abs(den) > tol, num / den)
        return F.when(t > tol, t)

    return rows.withColumn("gamma", F.least(one(F.col(C) - F.col("c"), F.col(A) - F.col("a")), one(F.col(C) + F.col("c"), F.col(A) + F.col("a"))))


def first_step(corr: DataFrame, inner: DataFrame) -> DataFrame:
    """gamma of every inactive column at the first least-angle step.

    corr is (j, c); inner (j, a) has the products with the column that won.
    With one active unit column A is 1 and C its |c|.
    """
    top = corr.agg(F.max_by(F.struct("j", "c"), F.struct(F.abs("c").alias("a"), (-F.col("j")).alias("i"))).alias("w"))
    d = with_scalars(corr.join(inner, "j"), top).filter(F.col("j") != F.col("w.j"))
    d = d.withColumn("a", F.col("a") * F.signum(F.col("w.c"))).withColumn("big_c", F.abs(F.col("w.c"))).withColumn("big_a", F.lit(1.0))
    return step_lengths(d).select("j", "gamma")


def entry_order(path: DataFrame, tol: float = 1e-12) -> DataFrame:
    """(j, entry_step, entry_pos) from (step, j, beta): the first step with a coefficient; ties by j."""
    e = path.filter(F.abs("beta") > tol).groupBy("j").agg(F.min("step").alias("entry_step"))
    return global_rank(e, ["entry_step", "j"]).withColumn("entry_pos", F.col("rank").cast("int")).drop("rank")


def fit_statistics(path: DataFrame, sigma2: float | None = None) -> DataFrame:
    """(step, rss, r2, cp, dof) from residual sums (step, rss, dof) with n and ssy."""
    last = path.agg(F.max_by(F.struct("rss", "dof"), "step").alias("f"))
    d = with_scalars(path, last)
    s2 = F.lit(sigma2) if sigma2 else F.when((F.col("f.dof") < F.col("n")) & (F.col("f.rss") > 0), F.col("f.rss") / (F.col("n") - F.col("f.dof")))
    return d.select("step", "rss", (1 - F.col("rss") / F.col("ssy")).alias("r2"), (F.col("rss") / s2 - F.col("n") + 2 * F.col("dof")).alias("cp"), "dof")
