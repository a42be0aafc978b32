"""Simulated responses over genotype columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.functions.columns import with_scalars
from fdrspark.functions.rng import normal, unit
from fdrspark.operators.design import pick, relative_risk, weighted_sample


def causal_columns(columns: DataFrame, s: int, seed: int) -> DataFrame:
    """s of the columns (j), drawn by hash order."""
    return pick(columns.select("j"), "j", s, seed)


def risk_scores(samples: DataFrame, dosages: DataFrame, causal: DataFrame, seed: int, low: float = 1.05, high: float = 1.25) -> DataFrame:
    """(row_id, risk): product over causal columns of 1, h, h^2, each column with its own h between low and high and its own risk allele.

    Genotypes that are absent from dosages (row_id, j, g) are 0.
    """
    c = causal.select("j", (low + (high - low) * unit(seed, F.lit("h"), F.col("j"))).alias("h"), (unit(seed, F.lit("a"), F.col("j")) < 0.5).alias("flip"))
    here = dosages.join(c, "j")
    log = F.log(F.col("h"))
    part = here.groupBy("row_id").agg(F.sum(F.when(F.col("flip"), -F.col("g") * log).otherwise(F.col("g") * log)).alias("_l"))
    base = c.agg(F.coalesce(F.sum(F.when(F.col("flip"), 2.0 * log).otherwise(0.0)), F.lit(0.0)).alias("_b"))
    d = with_scalars(samples.select("row_id").join(part, "row_id", "left"), base)
    return d.select("row_id", F.exp(F.coalesce("_l", F.lit(0.0)) + F.col("_b")).alias("risk"))


def case_control(risk: DataFrame, prevalence: float, n: int, seed: int) -> DataFrame:
    """(row_id, y): int(n * prevalence + 0.5) cases drawn by risk."""
    cases = weighted_sample(risk, "row_id", "risk", int(n * prevalence + 0.5), seed).select("row_id", F.lit(1.0).alias("y1"))
    return risk.select("row_id").join(cases, "row_id", "left").select("row_id", F.coalesce("y1", F.lit(0.0)).alias("y"))


def linear(signal: DataFrame, heritability: float, seed: int) -> DataFrame:
    """(row_id, y): signal (row_id, s) with noise of variance var(s) (1 - h2) / h2."""
    v = signal.agg((F.var_pop("s") * (1 - heritability) / heritability).alias("_v"))
    return with_scalars(signal, v).select("row_id", (F.col("s") + F.sqrt("_v") * normal(seed, F.col("row_id"))).alias("y"))


def liability(signal: DataFrame, heritability: float, prevalence: float, seed: int) -> DataFrame:
    """(row_id, y): 1 where a linear response reaches its upper ``prevalence`` quantile."""
    y = linear(signal, heritability, seed)
    cut = y.agg(F.percentile("y", F.lit(1 - prevalence)).alias("_q"))
    return with_scalars(y, cut).select("row_id", (F.col("y") >= F.col("_q")).cast("double").alias("y"))


def relative_risks(dosages: DataFrame, h: float, risk_allele: int = 1) -> DataFrame:
    return dosages.select("row_id", "j", relative_risk(F.col("g"), h, risk_allele).alias("rr"))
