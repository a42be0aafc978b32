"""Races over a matrix that stays distributed: column blocks meet the residuals of all experiments at once.

Each round is one job. It multiplies every block of columns with the residuals
and directions of all experiments (two GEMMs), and returns per block and
experiment the best column alone. The driver holds what grows with rows and
active columns, never with the number of columns. Blocks keep no state, so a
lost executor's blocks are simply multiplied again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.plans.kernels import DUMMY, REAL, LeastAngle

_TOL = 1e-10


class _Remote(LeastAngle):
    """A least angle race whose real columns come from a job; the pool is at hand."""

    def __init__(self, y, p, n_dummies, seed, experiment):
        super().__init__(np.zeros((len(y), 0)), y, n_dummies, seed, experiment)
        self.p = p
        self.taken: dict[int, np.ndarray] = {}

    def enter_real(self, j: int, column: np.ndarray, product: float) -> None:
        sign = 1.0 if product >= 0 else -1.0
        self.taken[j] = column
        if not self.widen(column):
            return
        self.entries.append((REAL, j, self.n_made))
        self.append_active(sign * column)
        self.sign = np.append(self.sign, sign)
        self.coef = np.append(self.coef, 0.0)
        self.after_entry(column)

    def direction(self):
        w = np.linalg.solve(self.gram, np.ones(len(self.gram)))
        a = 1 / np.sqrt(max(w.sum(), 1e-300))
        return self.active @ (w * a), w * a, a


def _round(features: DataFrame, asks: list[tuple]) -> list:
    """For each experiment the best column: of greatest product if it has no direction, else of least step.

    asks are (k, residual, direction or None, top, a_top, taken columns).
    """
    told = features.sparkSession.sparkContext.broadcast(asks)

    def run(batches):
        first = {}
        for b in batches:
            if not b.num_rows:
                continue
            j = b.column(0).to_numpy()
            x = np.array(b.column(1).flatten().to_numpy()).reshape(len(j), -1)
            res = np.column_stack([a[1] for a in told.value])
            way = np.column_stack([a[2] if a[2] is not None else 0 * a[1] for a in told.value])
            c, a = x @ res, x @ way
            out = []
            for i, (k, _, u, top, a_top, taken) in enumerate(told.value):
                ok = ~np.isin(j, list(taken))
                if u is None:
                    v = np.where(ok, -np.abs(c[:, i]), np.inf)
                else:
                    v = np.full(len(j), np.inf)
                    for num, den in ((top - c[:, i], a_top - a[:, i]), (top + c[:, i], a_top + a[:, i])):
                        with np.errstate(divide="ignore", invalid="ignore"):
                            t = np.where(ok & (np.abs(den) > _TOL), num / den, np.inf)
                        v = np.minimum(v, np.where(t > _TOL, t, np.inf))
                best = np.lexsort((j, v))[0]
                if np.isfinite(v[best]):
                    out.append((k, float(v[best]), int(j[best]), x[best].tolist()))
            for o in out:
                if o[0] not in first or o[1:3] < first[o[0]][1:3]:
                    first[o[0]] = o
        out = list(first.values())
        if out:  # a row for each race and task
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.float64()))], names=["k", "value", "j", "x"])

    best = features.select("j", "x").mapInArrow(run, "k int, value double, j int, x array<double>")
    got = best.groupBy("k").agg(F.min_by(F.struct("value", "j", "x"), F.struct("value", "j")).alias("b")).collect()
    told.destroy()
    return got


class BlockRaces:
    """Least angle races over (j, x array) that keep their states on the driver between calls of ``run``."""

    def __init__(self, features: DataFrame, y: np.ndarray, p: int, n_dummies: int, experiments: int, seed: int = 0, max_rounds: int = 10_000):
        self.features, self.n_dummies, self.max_rounds = features, n_dummies, max_rounds
        self.races = [_Remote(np.asarray(y, float), p, n_dummies, seed, k) for k in range(experiments)]
        self.done: set[int] = set()

    def run(self, t: int) -> BlockRaces:
        """Each race goes on until its t-th null column; an error after ``max_rounds`` rounds."""
        rs = self.races
        going = {k for k, r in enumerate(rs) if r.status == "running" and r.n_made < t} - self.done
        for _ in range(self.max_rounds):
            if not going:
                return self
            pending, asks = {}, []
            for k in sorted(going):
                r = rs[k]
                if r.entries:
                    u, w, a = r.direction()
                    top = float(np.abs(r.active.T @ r.residual).max())
                    asks.append((k, r.residual, u, top, a, set(r.taken)))
                    pending[k] = (u, w, a, top)
                else:
                    asks.append((k, r.residual, None, 0.0, 0.0, set()))
            got = {row["k"]: row["b"] for row in _round(self.features, asks)}
            for k in sorted(going):
                if not self._move(rs[k], got.get(k), pending.get(k)):
                    self.done.add(k)
                if k in self.done or rs[k].n_made >= t or rs[k].status != "running":
                    going.discard(k)
        if going:
            raise RuntimeError(f"{len(going)} races are still running after {self.max_rounds} rounds; raise max_rounds")
        return self

    def _move(self, r: _Remote, b, ask) -> bool:
        """A race's step, given the best column of the matrix; False once nothing is left to enter."""
        null = np.where(r.open, r.pool_products(r.residual), 0.0)
        if ask is None:
            d = int(np.abs(null).argmax()) if self.n_dummies else -1
            if b is not None and (d < 0 or -b["value"] > abs(null[d])):
                x = np.array(b["x"])
                r.enter_real(b["j"], x, float(x @ r.residual))
            elif d >= 0:
                r._join(DUMMY, d, float(null[d]))
            return True
        u, w, a, top = ask
        a_null = r.pool_products(u)
        gamma = b["value"] if b is not None else np.inf
        gamma_null, d = r._least(null, a_null, r.open, top, a)
        full = top / a
        move = min(gamma, gamma_null, full)
        r.fit = r.fit + move * u
        r.coef = r.coef + move * w
        r.residual = r.y - r.fit
        if gamma_null < gamma + _TOL and gamma_null <= full:
            r._join(DUMMY, d, float(null[d] - move * a_null[d]))
        elif move < full:
            x = np.array(b["x"])
            r.enter_real(b["j"], x, float(x @ r.residual))
        else:
            return False
        return True

    def entries(self, spark: SparkSession) -> DataFrame:
        """(k, pos, kind, idx, t0) so far."""
        rows = [(k, i + 1, kind, idx, t0) for k, r in enumerate(self.races) for i, (kind, idx, t0) in enumerate(r.entries)]
        return spark.createDataFrame(rows, "k int, pos int, kind string, idx int, t0 int")


def block_races(spark: SparkSession, features: DataFrame, y: np.ndarray, p: int, n_dummies: int, t: int, experiments: int, seed: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """(k, pos, kind, idx, t0): entries of least angle races over (j, x array), each until its t-th null column."""
    return BlockRaces(features, y, p, n_dummies, experiments, seed, max_rounds).run(t).entries(spark)
