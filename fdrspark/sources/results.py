"""Result rows as JSON and CSV, and metadata of a run."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """JSON objects of all files; run and method come from names like run_3_bh.json; what can't be parsed is left out, with a warning that names the files."""
    kept = spark.read.option("mode", "DROPMALFORMED").json(glob)
    bad = spark.read.text(glob).select("value", F.input_file_name().alias("f")).filter((F.trim("value") != "") & F.try_parse_json("value").isNull())
    names = [r["f"] for r in bad.select("f").distinct().limit(20).collect()]
    if names:
        warnings.warn(f"lines that can't be read in {', '.join(sorted(names))}", stacklevel=2)
    d = kept.withColumn("_f", F.input_file_name())
    return d.withColumn("run", F.regexp_extract("_f", r"run_(\d+)_", 1).cast("int")).withColumn("method", F.regexp_extract("_f", r"run_\d+_(\w+)\.json", 1)).drop("_f")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """Nothing happens where the table is there already."""
    df.write.mode("ignore").parquet(path)


def write_meta(spark: SparkSession, path: str, meta: dict, kept: list[str]) -> None:
    """meta as one JSON object, and the kept columns' names as text."""
    chroms = "array<struct<chrom:int,p_raw:bigint,p_pruned:bigint,n_clusters:bigint>>"
    fields = [f"{k} {chroms if k == 'per_chromosome' else {bool: 'boolean', int: 'bigint', float: 'double', str: 'string'}[type(v)]}" for k, v in meta.items()]
    spark.createDataFrame([tuple(meta.values())], ", ".join(fields)).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    spark.createDataFrame([(i, s) for i, s in enumerate(kept)], "i int, value string").orderBy("i").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/kept")
