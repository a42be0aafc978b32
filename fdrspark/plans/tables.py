"""Races as tables: the accessors of a race, and a table function that runs races from SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from fdrspark.plans import kernels


def accessor_tables(spark: SparkSession, race: kernels.Race) -> dict[str, DataFrame]:
    """What a race shows: ``summary`` (one row), ``products`` (kind, idx, c), ``pool`` (d, m, coordinate), ``entries`` and ``beta``."""
    s = kernels.state_of(race)
    summary = [(s["status"], s["n_samples"], s["n_features"], s["num_dummies"], s["num_realized"], s["basis_size"])]
    products = [(kind, i, float(c)) for kind, key in (("real", "corr_real"), ("dummy", "corr_pool")) for i, c in enumerate(s[key])]
    pool = [(int(d), int(m), float(a)) for m, row in enumerate(np.asarray(s["coords"])) for d, a in enumerate(row)]
    return {
        "summary": spark.createDataFrame(summary, "status string, n_samples int, n_features int, num_dummies int, num_realized int, basis_size int"),
        "products": spark.createDataFrame(products, "kind string, idx int, c double"),
        "pool": spark.createDataFrame(pool, "d int, m int, coordinate double"),
        "entries": spark.createDataFrame([(i + 1, kind, idx, t0) for i, (kind, idx, t0) in enumerate(s["entries"])], "pos int, kind string, idx int, t0 int"),
        "beta": spark.createDataFrame([(j, b) for j, b in sorted(s["beta"].items())], "j int, beta double"),
    }


def register_races(spark: SparkSession, name: str, x: np.ndarray, y: np.ndarray, solver: str = "lars", **options) -> None:
    """A table function ``name(experiment, n_dummies, t)`` for SQL, with a row (pos, kind, idx, t0) per entry; X is sent to executors once."""
    data = spark.sparkContext.broadcast((np.asarray(x, float), np.asarray(y, float)))

    class Races:
        def eval(self, experiment: int, n_dummies: int, t: int):
            a, b = data.value
            r = kernels.make(solver, a, b, n_dummies, experiment=experiment, **options).run(t)
            for i, (kind, idx, t0) in enumerate(r.entries):
                yield i + 1, kind, int(idx), int(t0)

    spark.udtf.register(name, udtf(Races, returnType="pos int, kind string, idx int, t0 int"))
