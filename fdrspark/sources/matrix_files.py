"""Headerless column-major float64 files, read and written by blocks of columns."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a task reads at a time; the environment can set another number.
BLOCK_COLUMNS = int(os.environ.get("FDRSPARK_BLOCK_COLUMNS", 8192))


class MatrixFile:
    """A file of n_rows x n_cols float64, column after column, with no header; its shape comes from the caller."""

    def __init__(self, path: str, n_rows: int, n_cols: int):
        size = os.path.getsize(path)
        if size != n_rows * n_cols * 8:
            raise ValueError(f"{path} has {size} bytes; {n_rows} x {n_cols} needs {n_rows * n_cols * 8}")
        self.path, self.n_rows, self.n_cols = path, n_rows, n_cols

    shape = property(lambda self: (self.n_rows, self.n_cols))
    nbytes = property(lambda self: self.n_rows * self.n_cols * 8)

    def __repr__(self) -> str:
        return f"MatrixFile({self.path!r}, {self.n_rows} x {self.n_cols})"

    def as_array(self) -> np.ndarray:
        """A read-only view; nothing is copied."""
        return np.memmap(self.path, np.float64, "r", shape=self.shape, order="F")

    def block(self, first: int, count: int) -> np.ndarray:
        with open(self.path, "rb") as f:
            f.seek(first * self.n_rows * 8)
            data = np.fromfile(f, np.float64, count * self.n_rows)
        if len(data) != count * self.n_rows:
            raise OSError(f"{self.path} ends within columns {first} to {first + count}")
        return data.reshape(count, self.n_rows)


def write_matrix(path: str, array: np.ndarray) -> MatrixFile:
    a = np.asarray(array, np.float64)
    if a.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    a.ravel(order="F").tofile(path)
    return MatrixFile(path, *a.shape)


def read_matrix(spark: SparkSession, path: str, n_rows: int, n_cols: int, columns: list[int] | None = None, block: int = BLOCK_COLUMNS) -> DataFrame:
    """(j, x array<double>): a task per block of columns; the path must be one that all executors see. Only blocks with asked columns are read."""
    f = MatrixFile(path, n_rows, n_cols)
    asked = None if columns is None else set(columns)
    starts = [s for s in range(0, n_cols, block) if asked is None or any(s <= c < s + block for c in asked)]

    def run(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                a = f.block(s, min(block, n_cols - s))
                keep = [i for i in range(len(a)) if asked is None or s + i in asked]
                for lo in range(0, len(keep), 256):
                    part = keep[lo : lo + 256]
                    x = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n_rows), pa.array(a[part].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([s + i for i in part], pa.int32()), x], names=["j", "x"])

    at = spark.createDataFrame([(s,) for s in starts], "s int").repartition(max(1, len(starts)), "s")
    return at.mapInArrow(run, "j int, x array<double>")


def standardised(features: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(j, x array) with each column centred and of unit length; constant columns become 0. Columns stay where they are."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    centred = features.withColumn("_m", total("x") / F.size("x")).select("j", F.transform("x", lambda v: v - F.col("_m")).alias("x"))
    length = F.greatest(F.sqrt(total(F.transform("x", lambda v: v * v))), F.lit(eps))
    return centred.withColumn("_l", length).select("j", F.transform("x", lambda v: v / F.col("_l")).alias("x"))


def gather(features: DataFrame, rows: list[int] | None = None, columns: list[int] | None = None) -> DataFrame:
    """(j, x array): the asked columns, and of each the asked rows in their order."""
    d = features if columns is None else features.filter(F.col("j").isin(list(columns)))
    if rows is None:
        return d
    at = F.array(*[F.lit(int(r)) for r in rows])
    return d.select("j", F.transform(at, lambda r: F.get("x", r)).alias("x"))


def load(spark: SparkSession, folder: str, n_rows: int, n_cols: int, columns: list[int] | None = None, standardise: bool = False) -> tuple[DataFrame, str]:
    """(features, load_mode) from a folder: standardised file, else raw file, else npz; an error if there is none.

    With ``standardise`` raw columns are standardised on the way.
    """
    finish = standardised if standardise else lambda d: d
    for name, mode in (("X_std.dat", "standardised"), ("X_raw.dat", "raw")):
        if os.path.exists(f"{folder}/{name}"):
            d = read_matrix(spark, f"{folder}/{name}", n_rows, n_cols, columns)
            return (d if mode == "standardised" else finish(d)), mode
    if os.path.exists(f"{folder}/X.npz"):
        z = np.load(f"{folder}/X.npz")
        x = z["X"] if "X" in z else z["X_raw"]
        rows = [(j, x[:, j].astype(float).tolist()) for j in (columns or range(x.shape[1]))]
        return finish(spark.createDataFrame(rows, "j int, x array<double>")), "npz"
    raise FileNotFoundError(f"{folder} has neither X_std.dat, X_raw.dat nor X.npz")


def write_blocks(parts: list[np.ndarray], path: str) -> tuple[MatrixFile, list[int]]:
    """Matrices side by side in one file, and each one's first column."""
    n = parts[0].shape[0]
    if any(p.shape[0] != n for p in parts):
        raise ValueError("parts differ in rows")
    offsets, at = [], 0
    with open(path, "wb") as f:
        for p in parts:
            offsets.append(at)
            for lo in range(0, p.shape[1], 2000):
                np.asarray(p[:, lo : lo + 2000], np.float64).ravel(order="F").tofile(f)
            at += p.shape[1]
    return MatrixFile(path, n, at), offsets
