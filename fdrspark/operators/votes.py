"""From entry events of many experiments to votes, an estimate of false discoveries, and a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fdrspark.functions.columns import with_scalars

EPS = 1e-12


def voting_grid(spark: SparkSession, k: int, eps: float = EPS) -> DataFrame:
    """(v_idx, v): 0.5, 0.5 + 1/K, ... below 1, then 1 - eps."""
    n = len([i for i in range(k) if 0.5 + i / k < 1])
    g = spark.range(n).select(F.col("id").cast("int").alias("v_idx"), (0.5 + F.col("id") / float(k)).alias("v"))
    return g.unionByName(spark.range(1).select(F.lit(n).alias("v_idx"), F.lit(1 - eps).alias("v")))


def votes(entries: DataFrame, k: int, t_max: int) -> DataFrame:
    """(t, j, phi): the share of experiments in which j is active once t dummies are.

    entries (k, j, t0): j entered experiment k after t0 dummies, so it counts from
    t0 + 1 on. A count per (j, t0), then running sums; rows with phi 0 are left out.
    """
    c = entries.filter(F.col("t0") < t_max).groupBy("j", "t0").agg(F.count("*").alias("n"))
    upto = c.withColumn("t", F.explode(F.sequence(F.col("t0") + 1, F.lit(t_max))))
    return upto.groupBy("t", "j").agg((F.sum("n") / float(k)).alias("phi"))


def increments(phi: DataFrame) -> DataFrame:
    """phi with dphi, the difference to the t before (0 before the first)."""
    w = Window.partitionBy("j").orderBy("t")
    before = F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("phi").over(w)).otherwise(0.0)
    return phi.withColumn("dphi", F.col("phi") - F.coalesce(before, F.lit(0.0)))


def deflated(phi: DataFrame, p: int, n_dummies: int, eps: float = EPS, held_only: bool = False) -> DataFrame:
    """(t, j, phi, phi_prime): for each horizon t the increments up to it, each shrunk by what dummies would have taken.

    The shrinkage at s depends on the horizon, because it looks at the columns
    that more than half of the experiments hold at t. Thresholds are one half and
    above, so that an estimate needs phi_prime of these columns alone: with
    ``held_only`` no others are worked out, and theirs is 0.
    """
    d = increments(phi)
    av = d.groupBy(F.col("t").alias("s")).agg(F.sum("phi").alias("av"))
    held = d.filter("phi > 0.5").select(F.col("t").alias("h"), "j")
    by = d.select(F.col("t").alias("s"), "j", "phi", "dphi")
    delta = held.join(by, "j").filter("s <= h").groupBy("h", "s").agg(F.sum("dphi").alias("dd"))
    denom = F.lit(float(n_dummies)) - F.col("s") + 1.0
    scale = delta.join(av, "s").withColumn("scale", F.when((F.col("dd") > eps) & (denom > 0), 1.0 - (p - F.col("av")) / denom / F.col("dd")).otherwise(0.0))
    rows = held.join(by, "j").filter("s <= h").join(scale.select("h", "s", "scale"), ["h", "s"]) if held_only else by.join(scale.select("h", "s", "scale"), "s")
    pp = rows.groupBy("h", "j").agg(F.sum(F.col("dphi") * F.col("scale")).alias("phi_prime"))
    return phi.join(pp.withColumnRenamed("h", "t"), ["t", "j"], "left").select("t", "j", "phi", F.coalesce("phi_prime", F.lit(0.0)).alias("phi_prime"))


def fdp_surface(dfl: DataFrame, grid: DataFrame, horizons: DataFrame) -> DataFrame:
    """(t, v_idx, v, fdp_hat, r) for all horizons (t) and thresholds; grid and horizons are small and fixed."""
    cells = horizons.crossJoin(F.broadcast(grid))
    over = dfl.join(F.broadcast(grid), F.col("phi") > F.col("v")).groupBy("t", "v_idx").agg(F.count("*").alias("r"), F.sum(1.0 - F.col("phi_prime")).alias("num"))
    j = cells.join(over, ["t", "v_idx"], "left")
    return j.select("t", "v_idx", "v", F.coalesce(F.least(F.lit(1.0), F.col("num") / F.col("r")), F.lit(0.0)).alias("fdp_hat"), F.coalesce("r", F.lit(0)).alias("r"))


def best_cell(surface: DataFrame, target: float) -> DataFrame:
    """The feasible cell that selects most; ties go to the larger threshold, then to the larger t. No row if none is feasible."""
    return surface.filter(F.col("fdp_hat") <= target).orderBy(F.desc("r"), F.desc("v_idx"), F.desc("t")).limit(1)


def selection(phi: DataFrame, cell: DataFrame) -> DataFrame:
    """(j, phi, v, t) of the columns above the cell's threshold."""
    c = cell.select(F.col("t").alias("_t"), "v")
    return phi.join(F.broadcast(c), (phi["t"] == c["_t"]) & (phi["phi"] > c["v"])).select("j", "phi", "v", "t")


def least_feasible(surface: DataFrame, alphas: DataFrame) -> DataFrame:
    """(alpha, t, v_idx): the least feasible threshold for each level and t, -1 if there is none."""
    s = surface.crossJoin(F.broadcast(alphas))
    return s.groupBy("alpha", "t").agg(F.coalesce(F.min(F.when(F.col("fdp_hat") <= F.col("alpha"), F.col("v_idx"))), F.lit(-1)).alias("v_idx"))


def stopping_time(surface: DataFrame, above: DataFrame, target: float, stride: int, max_stale: int, t_max: int) -> DataFrame:
    """(t_stop): where the stride loop ends.

    above is (t, n_above): columns that more than half of the experiments hold.
    Checks come after each stride and at t_max; the first ends it at which the
    estimate at the top threshold passes the target, or the count has not grown
    for max_stale checks in a row.
    """
    top = surface.groupBy("t").agg(F.max_by("fdp_hat", "v_idx").alias("f"))
    c = top.join(above, "t", "left").filter((F.col("t") % stride == 0) | (F.col("t") == t_max)).withColumn("n", F.coalesce("n_above", F.lit(0)))
    w = Window.orderBy("t")
    c = c.withColumn("grew", (F.col("n") > F.coalesce(F.lag("n").over(w), F.lit(0))).cast("int"))
    c = c.withColumn("island", F.sum("grew").over(w)).withColumn("stale", F.sum(1 - F.col("grew")).over(Window.partitionBy("island").orderBy("t")))
    return c.agg(F.coalesce(F.min(F.when((F.col("f") > target) | (F.col("stale") >= max_stale), F.col("t"))), F.lit(t_max)).alias("t_stop"))


def fdp_tpp(selected: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """fdp, tpp, n_selected of selections (j, and the columns of by) against truth (j)."""
    t = truth.select("j", F.lit(1).alias("_true"))
    p = truth.agg(F.count("*").alias("_p"))
    d = selected.join(t, "j", "left").groupBy(*(by or [])).agg(F.count("*").alias("n_selected"), F.count("_true").alias("tp"))
    d = with_scalars(d, p)
    return d.select(*(by or []), "n_selected", F.when(F.col("n_selected") > 0, (F.col("n_selected") - F.col("tp")) / F.col("n_selected")).otherwise(0.0).alias("fdp"), F.when(F.col("_p") > 0, F.col("tp") / F.col("_p")).otherwise(0.0).alias("tpp"))
