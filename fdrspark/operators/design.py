"""Design matrices: standardising, centring, products with vectors, layouts, recoding, quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.functions.columns import present, sent, with_scalars
from fdrspark.functions.rng import unit
from fdrspark.functions.tails import normal_two_sided
from fdrspark.operators.marginal import global_rank

EPS = 1e-12


def standardise(long: DataFrame, eps: float = EPS) -> DataFrame:
    """(row_id, j, x) with each column centred and of unit length; constant columns become 0."""
    s = long.groupBy("j").agg(F.avg("x").alias("m"), F.greatest(F.sqrt(F.count("*") * F.var_pop("x")), F.lit(eps)).alias("nrm"))
    return long.join(s, "j").select("row_id", "j", ((F.col("x") - F.col("m")) / F.col("nrm")).alias("x"))


def standardise_unit_variance(long: DataFrame, eps: float = EPS) -> DataFrame:
    """(row_id, j, x) with each column centred and of unit sample variance."""
    s = long.groupBy("j").agg(F.avg("x").alias("m"), F.greatest(F.stddev_samp("x"), F.lit(eps)).alias("sd"))
    return long.join(s, "j").select("row_id", "j", ((F.col("x") - F.col("m")) / F.col("sd")).alias("x"))


def standardise_guarded(long: DataFrame, eps: float = EPS) -> DataFrame:
    """(j, mean, norm, dropped): what a model needs to undo the scaling; near-constant columns are marked."""
    n = F.count("*")
    norm = F.sqrt(n * F.var_pop("x"))
    s = long.groupBy("j").agg(F.avg("x").alias("mean"), norm.alias("norm"), n.alias("n"))
    low = F.col("norm") / F.sqrt("n") < eps
    return s.select("j", "mean", F.when(low, eps * F.sqrt("n")).otherwise(F.col("norm")).alias("norm"), low.alias("dropped"))


def preprocess(long: DataFrame, eps: float = EPS) -> tuple[DataFrame, DataFrame]:
    """(row_id, j, x) centred and scaled, without near-constant columns, and the model (j, mean, norm, dropped) that undoes it."""
    model = standardise_guarded(long, eps)
    kept = long.join(model.filter("NOT dropped"), "j")
    return kept.select("row_id", "j", ((F.col("x") - F.col("mean")) / F.col("norm")).alias("x")), model


def restore(long: DataFrame, model: DataFrame) -> DataFrame:
    """(row_id, j, x) as before ``preprocess``; a dropped column is its mean in each row."""
    back = long.join(model.filter("NOT dropped"), "j").select("row_id", "j", (F.col("x") * F.col("norm") + F.col("mean")).alias("x"))
    gone = long.select("row_id").distinct().crossJoin(F.broadcast(model.filter("dropped").select("j", F.col("mean").alias("x"))))
    return back.unionByName(gone.select("row_id", "j", "x"))


def center(df: DataFrame, column: str) -> DataFrame:
    m = df.agg(F.avg(column).alias("_m"))
    return with_scalars(df, m).withColumn(column, F.col(column) - F.col("_m")).drop("_m")


def xt_times(long: DataFrame, v: DataFrame, value: str = "y") -> DataFrame:
    """(j, c): X^T v. Partial sums are formed before the shuffle, so that it carries a row per column and task."""
    return long.join(sent(v.select("row_id", F.col(value).alias("_v"))), "row_id").groupBy("j").agg(F.sum(F.col("x") * F.col("_v")).alias("c"))


def x_times(long: DataFrame, w: DataFrame) -> DataFrame:
    """(row_id, v): X w for (j, w); columns of weight 0 are never joined."""
    return long.join(w.filter("w <> 0"), "j").groupBy("row_id").agg(F.sum(F.col("x") * F.col("w")).alias("v"))


def predict(long: DataFrame, model: DataFrame, intercept: float = 0.0) -> DataFrame:
    """(row_id, prediction) for a model (j, mean, norm, beta) of standardised columns."""
    t = long.join(model.filter("beta <> 0"), "j")
    return t.groupBy("row_id").agg((F.sum((F.col("x") - F.col("mean")) / F.col("norm") * F.col("beta")) + intercept).alias("prediction"))


def feature_major(long: DataFrame) -> DataFrame:
    """(j, x array<double>): a row per column, elements in the order of row_id."""
    a = long.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("row_id", "x"))).alias("a"))
    return a.select("j", F.transform("a", lambda s: s["x"]).alias("x"))


def to_long(features: DataFrame) -> DataFrame:
    return features.select(F.posexplode("x").alias("row_id", "x"), "j").select(F.col("row_id").cast("long"), "j", "x")


def recode_dosage(g: Column) -> Column:
    """A genotype 0, 1 or 2; missing is 0."""
    return F.least(F.greatest(F.rint(present(g)), F.lit(0.0)), F.lit(2.0))


def relative_risk(g: Column, h: float, risk_allele: int = 1) -> Column:
    """Multiplicative risk 1, h or h^2 by copies of the risk allele."""
    g = recode_dosage(g)
    copies = g if risk_allele else 2.0 - g
    return F.when(copies == 0, 1.0).when(copies == 1, F.lit(h)).otherwise(F.lit(h * h))


def quality_control(dosages: DataFrame, n_rows: int | Column, maf: float = 0.01, call_rate: float = 0.95, hwe_chi2: float = 23.928) -> DataFrame:
    """(j, maf, call_rate, hwe_chi2, hwe_p, passes) of (j, g), g null where not called; the default chi2 bound is p = 1e-6 at 1 df."""
    g = F.col("g")
    s = dosages.groupBy("j").agg(F.count("g").alias("n"), F.sum(g).alias("s"), *[F.sum((g == k).cast("long")).alias(f"n{k}") for k in range(3)])
    q = F.col("s") / (2.0 * F.col("n"))
    expected = [F.col("n") * (1 - q) * (1 - q), 2.0 * F.col("n") * q * (1 - q), F.col("n") * q * q]
    chi2 = sum((F.when(e > 0, (F.col(f"n{k}") - e) * (F.col(f"n{k}") - e) / e).otherwise(0.0) for k, e in enumerate(expected)), F.lit(0.0))
    n_rows = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    out = s.select("j", F.least(q, 1 - q).alias("maf"), (F.col("n") / n_rows).alias("call_rate"), chi2.alias("hwe_chi2"))
    out = out.withColumn("hwe_p", normal_two_sided(F.sqrt("hwe_chi2")))  # one degree of freedom
    return out.withColumn("passes", (F.col("maf") >= maf) & (F.col("call_rate") >= call_rate) & (F.col("hwe_chi2") <= hwe_chi2))


def how_many(spec: int | str, n: int) -> int:
    """A number of runs out of n: a count as it stands, or a share like "0.5" or "1e-1", rounded down; 1 at least, n at most."""
    text = str(spec).strip()
    k = int(text) if text.lstrip("+-").isdigit() else int(float(text) * n + 1e-9)
    return max(1, min(k, n))


def pick(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows drawn without replacement by hash order; a top-k, so no row travels that can't win."""
    return df.withColumn("_u", unit(seed, F.col(key))).orderBy("_u", key).limit(k).drop("_u")


def stratified_split(df: DataFrame, key: str, cls: str, share: float, seed: int) -> DataFrame:
    """df with ``part``: 'screen' for the first int(n * share) of each class in hash order, else 'inference'."""
    n = df.groupBy(cls).agg(F.floor(F.count("*") * share).alias("_k"))
    w = Window.partitionBy(cls).orderBy(unit(seed, F.col(key)), F.col(key))
    d = df.withColumn("_r", F.row_number().over(w)).join(n, cls)
    return d.withColumn("part", F.when(F.col("_r") <= F.col("_k"), "screen").otherwise("inference")).drop("_r", "_k")


def weighted_sample(df: DataFrame, key: str, weight: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, by weight: the least of -ln(u) / w (Efraimidis and Spirakis)."""
    e = -F.log(1.0 - unit(seed, F.col(key))) / F.col(weight)
    return df.filter(F.col(weight) > 0).withColumn("_e", e).orderBy("_e", key).limit(k).drop("_e")


def common_samples(samples: DataFrame) -> DataFrame:
    """(chrom, iid, pos, rank): samples (chrom, iid, pos) that all chromosomes have, ranked by the lowest chromosome's order."""
    chroms = samples.agg(F.count_distinct("chrom").alias("_c"), F.min("chrom").alias("_first"))
    have = with_scalars(samples.groupBy("iid").agg(F.count_distinct("chrom").alias("n")), chroms).filter(F.col("n") == F.col("_c")).select("iid")
    common = samples.join(have, "iid", "left_semi")
    first = with_scalars(common, chroms.select("_first")).filter(F.col("chrom") == F.col("_first")).select("iid", "pos")
    first = global_rank(first, ["pos", "iid"]).select("iid", F.col("rank").cast("int").alias("rank"))
    return common.join(first, "iid").select("chrom", "iid", "pos", "rank")


def augment(real: DataFrame, dummies: DataFrame) -> DataFrame:
    """Columns of both, feature-major, numbered on; kind tells them apart."""
    p = real.agg(F.max("j").alias("_p"))
    d = with_scalars(dummies, p).withColumn("j", (F.col("j") + F.col("_p") + 1).cast("int")).drop("_p")
    return real.withColumn("kind", F.lit("real")).unionByName(d.withColumn("kind", F.lit("dummy")))
