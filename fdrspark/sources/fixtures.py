"""Design matrices made from the provided tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.functions.columns import with_scalars
from fdrspark.functions.rng import normal, normal_sql
from fdrspark.operators.design import center, standardise

SEED = 42
#: Column and sign of the planted effects.
PLANTED = ((3, 1.0), (10, -1.0), (20, 1.0), (40, -1.0), (50, 1.0))
MIN_DF = 10
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, j, x) of the embedding columns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("j", "x")).select("row_id", "j", F.col("x").cast("double").alias("x"))


def planted_response(x_std: DataFrame, snr: float = 1.0, seed: int = SEED) -> DataFrame:
    """(row_id, y): signed sum of the planted columns, hash-normal noise at the given SNR, centred."""
    b = F.element_at(F.create_map(*[F.lit(v) for jb in PLANTED for v in jb]), F.col("j"))
    s = x_std.filter(F.col("j").isin([j for j, _ in PLANTED])).groupBy("row_id").agg(F.sum(F.col("x") * b).alias("s"))
    noise = F.sqrt(F.col("v") / snr) * normal(seed, F.col("row_id"))
    y = with_scalars(s, s.agg(F.var_pop("s").alias("v"))).select("row_id", (F.col("s") + noise).alias("y"))
    return center(y, "y")


def planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = standardise(embedding_long(spark, sf_dir))
    return x, planted_response(x)


def text_dosages(spark: SparkSession, sf_dir: str, label: str = "toxic") -> tuple[DataFrame, DataFrame]:
    """(row_id, j, g): counts of words of at least MIN_DF labelled documents, 0/1/2 (0 left out); (row_id, y)."""
    lab = table(spark, sf_dir, "labels").filter(F.col(label).isNotNull()).select(F.col("doc_id").alias("row_id"), F.col(label).cast("double").alias("y"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text").join(lab.select("row_id"), "row_id", "left_semi")
    words = docs.select("row_id", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("j"))
    g = words.groupBy("row_id", "j").agg(F.least(F.count("*"), F.lit(2)).cast("double").alias("g"))
    often = g.groupBy("j").agg(F.count("*").alias("df")).filter(F.col("df") >= MIN_DF).select("j")
    return g.join(often, "j"), lab


X_SQL = "x AS (SELECT vec_id AS row_id, unnest(range(64))::INT AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"
XS_SQL = f"""{X_SQL},
xm AS (SELECT j, avg(x) AS m, greatest(sqrt(count(*) * var_pop(x)), 1e-12::DOUBLE) AS nrm FROM x GROUP BY j),
xs AS (SELECT row_id, j, (x - m) / nrm AS x FROM x JOIN xm USING (j))"""
BETA_SQL = "beta AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {b}::DOUBLE)" for j, b in PLANTED) + ") t(j, b))"
P_SQL = f"""{XS_SQL}, {BETA_SQL},
sig AS (SELECT row_id, sum(x * b) AS s FROM xs JOIN beta USING (j) GROUP BY row_id),
y0 AS (SELECT row_id, s + sqrt((SELECT var_pop(s) FROM sig)) * {normal_sql(SEED, "row_id")} AS y FROM sig),
y AS (SELECT row_id, y - (SELECT avg(y) FROM y0) AS y FROM y0)"""
B_SQL = f"""lab AS (SELECT doc_id AS row_id, toxic::DOUBLE AS y FROM labels WHERE toxic IS NOT NULL),
words AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(text, '{WORD}')) AS j FROM documents WHERE doc_id IN (SELECT row_id FROM lab)),
g0 AS (SELECT row_id, j, least(count(*), 2)::DOUBLE AS g FROM words GROUP BY row_id, j),
g AS (SELECT * FROM g0 WHERE j IN (SELECT j FROM g0 GROUP BY j HAVING count(*) >= {MIN_DF}))"""
