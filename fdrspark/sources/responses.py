"""Responses of runs: as tables, or as npz files that may bring columns of their own."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_response(spark: SparkSession, folder: str, run: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(row_id, y), the truth (j), and the run's own columns (j, x array) if it brings any.

    A table ``responses`` with (run, row_id, y), and ``causal`` with (run, j),
    comes first; else the file pheno_run_<run>.npz with y, causal_idx and maybe
    X_raw or Xc. An error if there is neither.
    """
    if os.path.isdir(f"{folder}/responses"):
        y = spark.read.parquet(f"{folder}/responses").filter(F.col("run") == run).select("row_id", "y")
        return y, spark.read.parquet(f"{folder}/causal").filter(F.col("run") == run).select("j"), None
    path = f"{folder}/pheno_run_{run}.npz"
    if not os.path.exists(path):
        raise FileNotFoundError(f"{folder} has no response of run {run}")
    z = np.load(path)
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z["y"])], "row_id long, y double")
    truth = spark.createDataFrame([(int(j),) for j in np.atleast_1d(z["causal_idx"])], "j int")
    own = next((z[k] for k in ("X_raw", "Xc") if k in z.files), None)
    columns = None if own is None else spark.createDataFrame([(j, own[:, j].astype(float).tolist()) for j in range(own.shape[1])], "j int, x array<double>")
    return y, truth, columns


def write_response(spark: SparkSession, folder: str, run: int, y: DataFrame, truth: DataFrame) -> bool:
    """Add a run to the tables; nothing happens, and False comes back, where it is there already."""
    if os.path.isdir(f"{folder}/responses/run={run}"):
        return False
    y.select("row_id", "y").write.parquet(f"{folder}/responses/run={run}")
    truth.select("j").write.mode("ignore").parquet(f"{folder}/causal/run={run}")
    return True
