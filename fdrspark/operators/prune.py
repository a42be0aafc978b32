"""Correlated columns: their pairs, clusters and representatives."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.functions.rng import unit
from fdrspark.session import shared_dir


def gram_rows(rows: DataFrame, p: int) -> DataFrame:
    """(i, v): row i of the p x p sums of centred products of rows (x array), as bytes; written to the shared folder.

    Each task adds up the product of its rows, so that the shuffle carries p rows
    of p numbers per task however many rows there are. Columns are centred by
    their means before; both passes read the same rows. For p of some thousands;
    wider matrices are clustered block by block with ``block_edges``.
    """
    means = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("ms")).select(F.transform("ms", lambda s: s["m"]).alias("m"))

    def run(batches):
        g = np.zeros((p, p))
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, p) - np.array(b.column(1)[0].as_py())
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array([r.tobytes() for r in g], pa.binary())], names=["i", "v"])

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(t.num_rows, p).sum(0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    parts = rows.select("x").crossJoin(F.broadcast(means)).mapInArrow(run, "i int, v binary")
    return _written(parts.groupBy("i").applyInArrow(add, "i int, v binary"))


def correlations(rows: DataFrame, p: int, eps: float = 1e-12, above: float = -1.0) -> DataFrame:
    """(j1, j2, r) for j1 < j2 with |r| above a bound; other pairs never leave their task."""
    g = gram_rows(rows, p)
    at = F.col("i") * 8
    own = {r["i"]: np.frombuffer(bytes(r["d"]))[0] for r in g.select("i", F.substring("v", at + 1, F.lit(8)).alias("d")).collect()}  # p numbers
    size = np.array([own.get(i, 0.0) for i in range(p)])

    def run(batches):
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = np.frombuffer(v) / np.maximum(np.sqrt(size[i] * size), eps)
                j = np.flatnonzero((np.arange(p) > i) & (np.abs(r) > above))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(j.astype(np.int32)), pa.array(r[j])], names=["j1", "j2", "r"])

    return g.mapInArrow(run, "j1 int, j2 int, r double")


def edges(rows: DataFrame, p: int, threshold: float = 0.7) -> DataFrame:
    return correlations(rows, p, above=threshold)


def block_edges(features: DataFrame, threshold: float = 0.7, block: int = 1024) -> DataFrame:
    """(j1, j2, r) of columns (j, x array) that are centred and of unit length, by pairs of column blocks.

    A task holds two blocks; each column goes to as many tasks as there are blocks.
    """
    n = features.agg(F.ceil((F.max("j") + 1) / block).cast("int").alias("_n"))
    own = F.floor(F.col("j") / block).cast("int")
    d = features.crossJoin(F.broadcast(n)).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    d = d.select(F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), "_own", "j", "x")

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        own, j = t.column("_own").to_numpy(), t.column("j").to_numpy()
        x = np.array(t.column("x").to_pylist(), float)
        left, right = own == a, own == b
        r = x[left] @ x[right].T
        i, k = np.nonzero(np.abs(r) > threshold)
        ja, jb = j[left][i], j[right][k]
        keep = ja < jb if a == b else np.ones(len(ja), bool)
        lo, hi = np.minimum(ja, jb)[keep], np.maximum(ja, jb)[keep]
        return pa.table({"j1": lo.astype(np.int32), "j2": hi.astype(np.int32), "r": r[i, k][keep]})

    return d.groupBy("a", "b").applyInArrow(run, "j1 int, j2 int, r double")


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/clusters-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clusters(columns: DataFrame, pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(j, cluster): components of the pairs (j1, j2) among columns (j), named by their least column.

    Labels spread along pairs and by jumps to the label's label; a round's table
    is written, which keeps the lineage short.
    """
    e = _written(pairs.select(F.col("j1").alias("a"), F.col("j2").alias("b")).unionByName(pairs.select(F.col("j2").alias("a"), F.col("j1").alias("b"))))
    lab = _written(columns.select("j", F.col("j").alias("cluster")))
    for _ in range(most_rounds):
        near = e.join(lab.select(F.col("j").alias("b"), F.col("cluster").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        one = lab.join(near, lab["j"] == near["a"], "left").select("j", "cluster", F.least("cluster", "c").alias("new"))
        jump = one.join(lab.select(F.col("j").alias("k"), F.col("cluster").alias("kc")), F.col("new") == F.col("k")).select("j", "cluster", F.least("new", "kc").alias("new"))
        jump = _written(jump)
        lab = jump.select("j", F.col("new").alias("cluster"))
        if jump.filter("new <> cluster").isEmpty():
            return lab
    raise RuntimeError("clusters still change; raise most_rounds")


def representatives(labelled: DataFrame, mode: str = "first", seed: int = 0) -> DataFrame:
    """(cluster, j, size): the least column of each cluster, or a random one by hash."""
    if mode not in ("first", "random"):
        raise ValueError(f"mode {mode!r} is neither first nor random")
    one = F.min("j") if mode == "first" else F.min_by("j", F.struct(unit(seed, F.col("j")), F.col("j")))
    return labelled.groupBy("cluster").agg(one.alias("j"), F.count("*").alias("size"))
