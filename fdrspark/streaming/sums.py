"""Tests per column over a stream: the sums that they need add up over micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.functions.columns import with_scalars
from fdrspark.operators.marginal import regression_statistic, trend_statistic
from fdrspark.session import shared_dir


def running_sums(stream: DataFrame) -> DataFrame:
    """(j, sx, sxx, sxy, sy, syy, m) of a stream (j, x, y); state is one row per column, whatever number of rows passes."""
    x, y = F.col("x"), F.col("y")
    return stream.groupBy("j").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.count("*").alias("m"))


def drained(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """A stream's result table once its source has no more: each micro-batch's table replaces the one before, on the shared folder.

    The driver holds no rows, and a restart goes on from the stream's checkpoint.
    """

    def write(table: DataFrame, epoch: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/sums-{epoch:09d}")
        last.append(epoch)

    last: list[int] = []
    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/sums-{last[-1]:09d}")


def sums_over_stream(spark: SparkSession, long: DataFrame, response: DataFrame) -> DataFrame:
    """The running sums of (row_id, j, x) and (row_id, y), read as a stream until the source has no more."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    long.join(response, "row_id").select("j", "x", "y").write.parquet(f"{path}/rows")
    kind = long.schema["j"].dataType.simpleString()
    stream = spark.readStream.schema(f"j {kind}, x double, y double").parquet(f"{path}/rows")
    return drained(spark, running_sums(stream), path)


def trend_over_stream(spark: SparkSession, dosages: DataFrame, cases: DataFrame, scaled: bool = True) -> DataFrame:
    """The trend test's (j, z) with dosages (row_id, j, g) read as a stream."""
    s = sums_over_stream(spark, dosages.withColumnRenamed("g", "x"), cases)
    one = cases.agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("n1"))
    return trend_statistic(with_scalars(s.select("j", "sx", "sxx", "sxy"), one), scaled)


def regression_over_stream(spark: SparkSession, long: DataFrame, response: DataFrame) -> DataFrame:
    """The marginal regression's (j, r, t, df) with (row_id, j, x) read as a stream; a screen passes only its own rows."""
    return regression_statistic(sums_over_stream(spark, long, response))
