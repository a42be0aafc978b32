"""Other selection methods over the same matrix, under one roof."""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.functions.rng import normal, normals, unit
from fdrspark.functions.tails import t_two_sided
from fdrspark.operators import marginal
from fdrspark.operators.design import xt_times
from fdrspark.operators.votes import fdp_tpp
from fdrspark.plans import selector
from fdrspark.plans.explicit import TerminatingPath
from fdrspark.session import shared_dir
from fdrspark.streaming import sums as streams

#: The widest matrix that a path screens; wider ones are screened column by column.
WIDE = 50_000

METHODS = ("trex", "bh", "by", "bh_stream", "by_stream", "bh_ols", "bh_hd", "by_hd", "ko_hd", "ko_id", "ko_gaussian")


def ols_p(x: np.ndarray, y: np.ndarray, intercept: bool) -> np.ndarray:
    """Two-sided p of each coefficient; the pseudo-inverse stands in for a singular Gram matrix."""
    a = np.column_stack([x, np.ones(len(x))]) if intercept else x
    dof = max(len(a) - a.shape[1], 1)
    inv = np.linalg.pinv(a.T @ a)
    b = inv @ (a.T @ y)
    s2 = ((y - a @ b) ** 2).sum() / dof
    se = np.sqrt(np.maximum(np.diag(inv) * s2, 1e-300))
    return t_two_sided(b / se, dof)[: x.shape[1]]


def equi_knockoffs(x: np.ndarray, seed: int) -> np.ndarray:
    """Fixed-X copies of n >= 2p unit columns: the same Gram matrix but for the diagonal between a column and its copy."""
    n, p = x.shape
    g = x.T @ x
    s = min(1.0, 2 * max(np.linalg.eigvalsh(g)[0], 0)) * 0.999
    inv = np.linalg.pinv(g)
    z = normals((seed, 41), np.arange(n * p)).reshape(n, p)
    q, _ = np.linalg.qr(np.column_stack([x, z]))
    u = q[:, p : 2 * p]
    c = 2 * s * np.eye(p) - s * s * inv
    w, v = np.linalg.eigh((c + c.T) / 2)
    return x @ (np.eye(p) - s * inv) + u @ (v * np.sqrt(np.maximum(w, 0))) @ v.T


def gaussian_knockoffs(x: np.ndarray, seed: int) -> np.ndarray:
    """Model-X copies under a Gaussian law with shrunk sample covariance."""
    n, p = x.shape
    cov = x.T @ x
    cov = 0.9 * cov + 0.1 * np.eye(p)
    s = min(1.0, 2 * max(np.linalg.eigvalsh(cov)[0], 0)) * 0.999
    inv = np.linalg.inv(cov)
    v = 2 * s * np.eye(p) - s * s * inv
    w, e = np.linalg.eigh((v + v.T) / 2)
    z = normals((seed, 43), np.arange(n * p)).reshape(n, p) / np.sqrt(n)
    return x - x @ inv * s + z @ (e * np.sqrt(np.maximum(w, 0))) @ e.T


def entry_statistics(x: np.ndarray, fake: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each column how early it enters a lasso path, against its copy."""
    p = x.shape[1]
    both = np.column_stack([x, fake])
    r = TerminatingPath(both / np.maximum(np.linalg.norm(both, axis=0), 1e-12), np.zeros((len(y), 0)), y, lasso=True).run(0, early_stop=False)
    order = np.zeros(2 * p)
    entered = list(dict.fromkeys(a - 1 for a in r.actions if a > 0))  # first entries
    for pos, i in enumerate(entered):
        order[i] = 2 * p - pos
    return np.maximum(order[:p], order[p:]) * np.sign(order[:p] - order[p:])


def _split(spark, n: int, share: float, seed: int, y: np.ndarray) -> np.ndarray:
    """Which rows screen: a share of each class of a binary response, else of all."""
    u = np.array([r["u"] for r in spark.range(n).select("id", unit(seed, F.col("id")).alias("u")).orderBy("id").collect()])
    classes = np.zeros(n, int) if len(np.unique(np.round(y, 6))) > 2 else (y > y.mean()).astype(int)
    out = np.zeros(n, bool)
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        out[rows[np.argsort(u[rows], kind="stable")[: int(len(rows) * share)]]] = True
    return out


def _screened(x, y, keep: int) -> np.ndarray:
    """The first ``keep`` columns of a lasso path; of more than WIDE columns, those of the largest marginal |r|, as where the path ends early."""
    xs = x - x.mean(0)
    xs = xs / np.maximum(np.linalg.norm(xs, axis=0), 1e-12)
    by_r = np.argsort(-np.abs(xs.T @ (y - y.mean())), kind="stable")
    picked: list[int] = []
    if x.shape[1] <= WIDE:
        r = TerminatingPath(xs, np.zeros((len(y), 0)), y - y.mean(), lasso=True)
        while len(picked) < keep and r.status == "running" and r._step():
            picked = list(dict.fromkeys(a - 1 for a in r.actions if a > 0))
    picked = list(dict.fromkeys([*picked, *by_r.tolist()]))[:keep]
    return np.sort(picked).astype(int)


def _pick(spark, names, cols, p_or_w: np.ndarray, kind: str, level: float) -> DataFrame:
    col = "p" if kind in ("bh", "by") else "w"
    d = spark.createDataFrame([(int(names[c]), float(v)) for c, v in zip(cols, p_or_w, strict=True)], f"j int, {col} double")
    if col == "p":
        return marginal.step_up(d, level, kind == "by").filter("reject").select("j", F.col("p").alias("statistic"))
    return marginal.knockoff_select(d, level).filter("selected").select("j", F.col("w").alias("statistic"))


def gram(long: DataFrame, response: DataFrame) -> tuple[list, np.ndarray]:
    """The names of the p columns, and Z^T Z of Z = (X, 1, y): tasks add up their rows' products, then each row of the result is added up over tasks.

    The driver holds p^2 numbers, never the rows; for p up to some thousands.
    """
    names = [r["j"] for r in long.select("j").distinct().orderBy("j").collect()]
    place = {j: i for i, j in enumerate(names)}
    p = len(names)
    wide = long.groupBy("row_id").agg(F.collect_list("j").alias("js"), F.collect_list("x").alias("xs")).join(response, "row_id").select("js", "xs", "y")

    def run(batches):
        total = np.zeros((p + 2, p + 2))
        for batch in batches:
            z = np.zeros((batch.num_rows, p + 2))
            size = np.asarray(batch.column(0).value_lengths())
            rows = np.repeat(np.arange(batch.num_rows), size)
            z[rows, [place[j] for j in batch.column(0).flatten().to_pylist()]] = batch.column(1).flatten().to_numpy()
            z[:, p], z[:, p + 1] = 1, batch.column(2).to_numpy()
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(p + 2), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "v"])

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(t.num_rows, p + 2).sum(0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    rows = wide.mapInArrow(run, "i int, v binary").groupBy("i").applyInArrow(add, "i int, v binary").collect()
    return names, np.array([np.frombuffer(bytes(r["v"])) for r in sorted(rows, key=lambda r: r["i"])]).reshape(p + 2, p + 2)


def ols_p_of_gram(g: np.ndarray) -> np.ndarray:
    """Two-sided p of each coefficient of a regression with intercept, from Z^T Z of Z = (X, 1, y)."""
    p, n = len(g) - 2, g[-2, -2]
    inv = np.linalg.pinv(g[:-1, :-1], hermitian=True)
    b = inv @ g[:-1, -1]
    dof = max(n - p - 1, 1)
    rss = max(g[-1, -1] - b @ g[:-1, -1], 0.0)
    return t_two_sided(b / np.sqrt(np.maximum(np.diag(inv) * rss / dof, 1e-300)), dof)[:p]


def is_binary(response: DataFrame) -> bool:
    """Whether a response takes no values but 0 and 1, and both."""
    got = response.agg(F.min("y"), F.max("y"), F.count_if(~F.col("y").isin(0.0, 1.0))).first()
    return tuple(got) == (0.0, 1.0, 0)


def p_values(spark: SparkSession, long: DataFrame, response: DataFrame, streamed: bool = False) -> DataFrame:
    """(j, p) of each column: of a full regression where rows are more than twice the columns and its p are all numbers, else one by one.

    One by one: the trend test for a binary response, else the marginal
    regression's t. Streamed tests are always one by one, from sums over a stream.
    """
    binary = is_binary(response)
    if not streamed:
        size = response.agg(F.count("*").alias("n")).crossJoin(long.agg(F.count_distinct("j").alias("p"))).first()
        if size["n"] > 2 * size["p"]:
            names, g = gram(long, response)
            p = ols_p_of_gram(g)
            if np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all():
                kind = long.schema["j"].dataType.simpleString()
                return spark.createDataFrame(list(zip(names, p.tolist(), strict=True)), f"j {kind}, p double")
    if binary:
        dosages = long.withColumnRenamed("x", "g")
        z = streams.trend_over_stream(spark, dosages, response) if streamed else marginal.trend_test(dosages, response)
        return marginal.with_p(z, "z").select("j", "p")
    t = streams.regression_over_stream(spark, long, response) if streamed else marginal.marginal_regression(long, response)
    return marginal.with_p(t, "t", "df").select("j", "p")


def run(spark: SparkSession, long: DataFrame, response: DataFrame, method: str, alpha: float = 0.1, seed: int = 0, screen_share: float = 0.375) -> DataFrame:
    """(j, statistic) of the columns that a method selects."""
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    if method == "trex":
        s = selector.select(spark, long, response, selector.Options(target=alpha, l_factor=5, mode="calibrate_t", stride=5, max_stale=2, seed=seed))
        return s.selected.select("j", F.col("phi").alias("statistic"))
    if method in ("bh", "by", "bh_stream", "by_stream"):
        d = p_values(spark, long, response, method.endswith("_stream"))
        return marginal.step_up(d, alpha, method.startswith("by")).filter("reject").select("j", F.col("p").alias("statistic"))
    if method == "bh_ols":
        names, g = gram(long, response)
        return _pick(spark, names, range(len(names)), ols_p_of_gram(g), "bh", alpha)
    if method == "ko_id":
        # Copies are independent normals, as they come; nothing leaves the cluster.
        fake = long.select("row_id", "j", normal(seed, F.col("row_id"), F.col("j")).alias("x"))
        pair = xt_times(long, response).join(xt_times(fake, response).withColumnRenamed("c", "ck"), "j")
        return marginal.knockoff_select(pair.select("j", (F.abs("c") - F.abs("ck")).alias("w")), alpha).filter("selected").select("j", F.col("w").alias("statistic"))
    x, y, names = selector.local_matrix(long, response)
    n, p = x.shape
    if method == "ko_gaussian":
        if is_binary(response):  # a little noise parts its ties
            y = y + 1e-6 * normals((seed, 44), np.arange(n))
        fake = equi_knockoffs(x, seed) if n >= 2 * p else gaussian_knockoffs(x, seed)
        return _pick(spark, names, range(p), entry_statistics(x, fake, y), "w", alpha)
    screen = _split(spark, n, screen_share, seed, y)
    n1 = int((~screen).sum())
    keep = min(max(1, int(0.25 * n1)), n1 // 2 - 1, p)
    cols = _screened(x[screen], y[screen], keep)
    xi, yi = x[~screen][:, cols], y[~screen]
    if method == "ko_hd":
        xi = xi - xi.mean(0)
        xi = xi / np.maximum(np.linalg.norm(xi, axis=0), 1e-12)
        return _pick(spark, names, cols, entry_statistics(xi, equi_knockoffs(xi, seed), yi - yi.mean()), "w", alpha)
    return _pick(spark, names, cols, ols_p(xi, yi, False), method[:2], alpha)


def run_all(spark: SparkSession, long: DataFrame, response: DataFrame, truth: list[int], methods: list[str], **options) -> DataFrame:
    """A row per method: n_disc, fdp, tpp, runtime_s, error; a method that fails is a row with its error."""
    t = spark.createDataFrame([(j,) for j in truth], "j int")
    rows = []
    # The data are made once, and read by each method.
    at = f"{shared_dir(spark)}/methods-{uuid.uuid4().hex}"
    long.write.parquet(f"{at}/long")
    response.write.parquet(f"{at}/response")
    long, response = (spark.read.schema(d.schema).parquet(f"{at}/{name}") for d, name in ((long, "long"), (response, "response")))
    for m in methods:
        began = time.time()
        try:
            s = fdp_tpp(run(spark, long, response, m, **options).select("j"), t).first()
            rows.append((m, s["n_selected"] if s else 0, s["fdp"] if s else 0.0, s["tpp"] if s else 0.0, time.time() - began, None))
        except Exception as e:  # an error is data here
            rows.append((m, None, None, None, time.time() - began, str(e)[:200]))
    return spark.createDataFrame(rows, "method string, n_disc long, fdp double, tpp double, runtime_s double, error string")
