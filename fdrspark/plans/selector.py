"""Selection at a target false discovery rate: many races, their votes, and the threshold.

Races are tasks over a broadcast matrix when that is small; ``block`` is the way
for wider ones. Everything after the races is DataFrame work.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.operators import votes as V
from fdrspark.operators.design import feature_major
from fdrspark.operators.marginal import global_rank
from fdrspark.plans import block, kernels
from fdrspark.session import shared_dir

#: A matrix of up to so many bytes is sent whole to each executor.
LOCAL_BYTES = 256 << 20
STATES = "k int, entries array<struct<pos:int,kind:string,idx:int,t0:int>>, status string, state binary"


@dataclass(frozen=True)
class Options:
    target: float = 0.2
    experiments: int = 20
    l_factor: int = 10
    t_stop: int = -1
    max_l_factor: int = 50
    stride: int = 1
    posthoc: bool = False
    max_stale: int = 3
    max_basis: int | None = None
    seed: int = 0
    solver: str = "lars"
    mode: str = "calibrate_both"
    law: str = "spherical"
    rho: float = 1.0

    def __post_init__(self):
        if self.mode not in ("fixed", "calibrate_t", "calibrate_l", "calibrate_both"):
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass
class Selected:
    """selected (j, phi, v, t), the surface (t, v_idx, v, fdp_hat, r), votes (t, j, phi, phi_prime), and one row about the run."""

    selected: DataFrame
    surface: DataFrame
    votes: DataFrame
    run: DataFrame
    t_explored: int
    n_dummies: int


def local_matrix(long: DataFrame, response: DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    """X, y and the names of X's columns on the driver; an error if X has more than LOCAL_BYTES."""
    size = long.agg(F.count_distinct("j").alias("p")).crossJoin(response.agg(F.count("*").alias("n"))).first()
    if size["p"] * size["n"] * 8 > LOCAL_BYTES:
        raise ValueError(f"{size['n']} x {size['p']} is beyond LOCAL_BYTES")
    y = np.array([r["y"] for r in response.orderBy("row_id").collect()])
    cols = feature_major(long).orderBy("j").collect()
    return np.array([r["x"] for r in cols]).T, y, [r["j"] for r in cols]


def races(spark: SparkSession, x: np.ndarray, y: np.ndarray, n_dummies: int, t: int, o: Options, experiments: range | None = None, saved: DataFrame | None = None, steps: int | None = None) -> DataFrame:
    """(k, entries, status, state) of each experiment up to its t-th null column, a task per experiment; written to the shared folder.

    With ``saved``, a table of before, races go on from their states.
    """
    ks = experiments or range(o.experiments)
    data = spark.sparkContext.broadcast((x, y))
    made = {"seed": o.seed, "law": o.law, "max_basis": o.max_basis}
    solver, rho = o.solver, o.rho

    def run(batches):
        a, b = data.value
        for batch in batches:
            states = batch.column(1).to_pylist()
            for k, state in zip(batch.column(0).to_pylist(), states, strict=True):
                r = kernels.SOLVERS[solver].load(state, a, b) if state else kernels.make(solver, a, b, n_dummies, rho=rho, experiment=k, **made)
                r.run(t, steps)
                e = [{"pos": i + 1, "kind": kind, "idx": idx, "t0": t0} for i, (kind, idx, t0) in enumerate(r.entries)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([e], kind_of), pa.array([r.status]), pa.array([r.save()], pa.binary())], names=["k", "entries", "status", "state"])

    kind_of = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("idx", pa.int32()), ("t0", pa.int32())]))
    begin = spark.range(ks.start, ks.stop, 1, len(ks)).select(F.col("id").cast("int").alias("k"), F.lit(None).cast("binary").alias("state"))
    if saved is not None:
        begin = saved.select("k", "state").repartition(len(ks), "k")
    out = begin.mapInArrow(run, STATES)
    path = f"{shared_dir(spark)}/races-{uuid.uuid4().hex}"
    out.write.parquet(path)
    data.destroy()
    return spark.read.schema(out.schema).parquet(path)


def entries_of(states: DataFrame) -> DataFrame:
    """ENTRIES of a table of races."""
    return states.select("k", F.explode("entries").alias("e"), "status").select("k", "e.pos", "e.kind", "e.idx", "e.t0", "status")


def _surface(spark, entries, p, n_dummies, t_max, o) -> tuple[DataFrame, DataFrame]:
    real = entries.filter("kind = 'real'").select("k", F.col("idx").alias("j"), "t0")
    phi = V.deflated(V.votes(real, o.experiments, t_max), p, n_dummies, held_only=True)
    horizons = spark.range(1, t_max + 1).select(F.col("id").cast("int").alias("t"))
    return phi, V.fdp_surface(phi, V.voting_grid(spark, o.experiments), horizons)


def _meets(entries: DataFrame, p: int, n_dummies: int, o: Options, v: float = 0.75) -> bool:
    """Whether the estimate after the first null column meets the target."""
    e = entries.filter("kind = 'real' AND t0 = 0").select("k", F.col("idx").alias("j"), "t0")
    phi = V.deflated(V.votes(e, o.experiments, 1), p, n_dummies, held_only=True)
    row = phi.filter(F.col("phi") > v).agg(F.count("*").alias("r"), F.sum(1 - F.col("phi_prime")).alias("num")).first()
    return not row["r"] or min(1.0, row["num"] / row["r"]) <= o.target


def calibrate_l(spark: SparkSession, x, y, o: Options, v: float = 0.75) -> int:
    """The least multiple of p null columns at which the estimate after the first one meets the target, else the greatest tried."""
    p = x.shape[1]
    for m in range(1, o.max_l_factor + 1):
        if _meets(entries_of(races(spark, x, y, m * p, 1, o)), p, m * p, o, v):
            return m * p
    return o.max_l_factor * p


class _Local:
    """Races over a matrix that each executor gets whole."""

    def __init__(self, spark, long, response, o):
        self.spark, self.o = spark, o
        self.x, self.y, self.names = local_matrix(long, response)
        self.n, self.p = self.x.shape
        self.states = None

    def calibrate(self) -> int:
        return calibrate_l(self.spark, self.x, self.y, self.o)

    def reach(self, n_dummies: int, t: int) -> DataFrame:
        """The entries up to t null columns; races go on from where the last call left them."""
        self.states = races(self.spark, self.x, self.y, n_dummies, t, self.o, saved=self.states)
        return entries_of(self.states)


class _Blocks:
    """Races over a matrix that stays distributed, in columns; least angle against spherical null columns."""

    def __init__(self, spark, long, response, o):
        if (o.solver, o.law) != ("lars", "spherical"):
            raise ValueError(f"a matrix beyond LOCAL_BYTES is raced over by lars against spherical null columns, not by {o.solver} against {o.law} ones")
        self.spark, self.o = spark, o
        self.y = np.array([r["y"] for r in response.orderBy("row_id").collect()])
        path = f"{shared_dir(spark)}/columns-{uuid.uuid4().hex}"
        # Columns are numbered in their order; the names stay in a table.
        ordered = global_rank(feature_major(long), ["j"]).select(F.col("j").alias("name"), (F.col("rank") - 1).cast("int").alias("j"), "x")
        ordered.write.parquet(path)
        self.features = spark.read.schema(ordered.schema).parquet(path)
        self.names = self.features.select(F.col("j").alias("i"), "name")
        self.n, self.p = len(self.y), self.features.count()
        self.race = None

    def _race(self, n_dummies: int) -> block.BlockRaces:
        return block.BlockRaces(self.features.select("j", "x"), self.y, self.p, n_dummies, self.o.experiments, self.o.seed)

    def calibrate(self) -> int:
        o = self.o
        for m in range(1, o.max_l_factor + 1):
            if _meets(self._race(m * self.p).run(1).entries(self.spark), self.p, m * self.p, o):
                return m * self.p
        return o.max_l_factor * self.p

    def reach(self, n_dummies: int, t: int) -> DataFrame:
        self.race = self.race or self._race(n_dummies)
        return self.race.run(t).entries(self.spark)


def select(spark: SparkSession, long: DataFrame, response: DataFrame, o: Options = Options()) -> Selected:
    """Select columns of (row_id, j, x), standardised, for (row_id, y), centred; the matrix's size chooses how races run, not what they give."""
    size = long.agg(F.count_distinct("j").alias("p")).crossJoin(response.agg(F.count("*").alias("n"))).first()
    m = (_Local if size["p"] * size["n"] * 8 <= LOCAL_BYTES else _Blocks)(spark, long, response, o)
    p, n, names = m.p, m.n, m.names
    n_dummies = m.calibrate() if o.mode in ("calibrate_l", "calibrate_both") else o.l_factor * p
    t_max = o.t_stop if o.t_stop > 0 else min(n_dummies, math.ceil(n / 2))
    fixed = o.mode in ("fixed", "calibrate_l")
    explored = t_max
    if fixed or o.posthoc:
        entries = m.reach(n_dummies, t_max)
        phi, surface = _surface(spark, entries, p, n_dummies, t_max, o)
        if fixed:  # the votes at t_max alone, as if they came with the first null column
            last = phi.filter(F.col("t") == t_max).select(F.lit(1).alias("t"), "j", "phi")
            phi = V.deflated(last, p, n_dummies, held_only=True)
            surface = V.fdp_surface(phi, V.voting_grid(spark, o.experiments), spark.range(1).select(F.lit(1).alias("t")))
    else:
        # The stopping rule looks at checks one after another; races run in chunks of strides, and go on from their states.
        reach = min(t_max, max(2 * o.stride, o.stride * (o.max_stale + 1)))
        while True:
            entries = m.reach(n_dummies, reach)
            phi, surface = _surface(spark, entries, p, n_dummies, reach, o)
            above = phi.filter("phi > 0.5").groupBy("t").agg(F.count("*").alias("n_above"))
            stop = V.stopping_time(surface, above, o.target, o.stride, o.max_stale, reach + 1 if reach < t_max else t_max).first()["t_stop"]
            if stop <= reach:
                explored = stop
                break
            reach = min(t_max, 2 * reach)
        phi, surface = phi.filter(F.col("t") <= explored), surface.filter(F.col("t") <= explored)
    if isinstance(names, DataFrame):
        label = names
    else:
        label = F.broadcast(spark.createDataFrame([(i, int(j) if isinstance(j, (int, np.integer)) else j) for i, j in enumerate(names)], "i int, name " + ("int" if isinstance(names[0], (int, np.integer)) else "string")))
    cell = V.best_cell(surface, o.target)
    chosen = V.selection(phi, cell).join(label, F.col("j") == F.col("i")).select(F.col("name").alias("j"), "phi", "v", "t")
    info = {**{k: v for k, v in asdict(o).items() if v is not None}, "n": n, "p": p, "n_dummies": n_dummies, "t_explored": explored}
    run = spark.createDataFrame([tuple(info.values())], list(info))
    return Selected(chosen, surface, phi, run, explored, n_dummies)


def path_table(spark: SparkSession, long: DataFrame, response: DataFrame, solver: str, t: int, n_dummies: int, seed: int = 1, rho: float = 1.0, max_steps: int | None = None) -> DataFrame:
    """(step, j, beta): a single race's coefficients, standardised scale."""
    x, y, names = local_matrix(long, response)
    r = kernels.make(solver, x, y, n_dummies, rho=rho, seed=seed).run(t, max_steps)
    rows = [(s, names[j], b) for s, coefs in enumerate(r.path) for j, b in sorted(coefs.items())]
    return spark.createDataFrame(rows, "step int, j int, beta double")
