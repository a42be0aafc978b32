"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.llm.common import WORD_PATTERN, stored, table, unit_hash

#: A source is repeated at most so many times.
MAX_RATE = 3.0
SEED = "mix-1"
#: Up to so many sources, their targets (three numbers and a name each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Sources that one task sorts.
SORTED_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def in_order(rows: DataFrame, by: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with sums of columns over all rows before them in an order that tells all apart, and their place (from 0).

    Ranges of the order are sorted apart; a row for each range gives its offsets.
    """
    n = rows.count()
    if n <= SORTED_ROWS:
        before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*rows.columns, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(k) for k, c in {**sums, "place": F.lit(1)}.items()])
    d = stored(rows.repartitionByRange(-(-n // SORTED_ROWS), *by).withColumn("_part", F.spark_partition_id()), name)
    sums = {**sums, "place": F.lit(1)}
    before = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}") for k in sums])
    d = d.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    return d.select(*rows.columns, *[(F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"_{k}")).alias(k) for k, c in sums.items()])


def source_targets(sizes: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on.
    They share the sum of all sizes by weight; none gets more than ``max_rate``
    times its own size, and what it would get beyond goes to the others by
    weight, until none is above. That fixed point is min(cap, level * weight)
    with one level for all, found by prefix sums over the sources in the order
    in which they reach their caps. No task sorts more than SORTED_ROWS sources.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    name = F.col("source").asc_nulls_last()
    per = in_order(per, [name], {}, "sources").withColumn("w", F.col("place") % 3 + 1)
    per = per.withColumn("cap", F.lit(max_rate) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w")).drop("place")
    per = stored(in_order(per, [F.col("fill"), name], {"caps": F.col("cap"), "ws": F.col("w")}, "fills"), "levels")
    every = per.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w_all"))
    level = (F.col("total") - F.col("caps")) / (F.col("w_all") - F.col("ws"))
    per = per.crossJoin(F.broadcast(every)).withColumn("level", level)  # one row of sums
    # The level that holds is the one at the first source which it leaves below its cap.
    held = per.agg(F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).alias("held")).select(F.col("held.level").alias("held"))
    target = F.least(F.col("cap"), F.coalesce(F.col("held"), F.col("fill")) * F.col("w"))
    return per.crossJoin(F.broadcast(held)).select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_rate: float = MAX_RATE, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each row.

    Returns id, size, source, source_size, target, rate, copies (and the columns
    of ``keep`` as the struct ``kept``; other columns, whatever their names, are not
    read). A source's rate is target / source_size; each row is taken
    floor(rate) times, and once more where a hash of the seed, its id and its text
    falls below the fraction, so reruns agree. A row without words
    has size 0 and counts nothing; a source of size 0 has target and rate 0. Null
    sources are one source, null texts have size 0, null ids differ by their texts;
    rows that repeat all that is read of them are numbered and drawn one by one; an
    empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null")).alias("_text"), *([F.struct(*keep).alias("kept")] if keep else []),
    )
    per = stored(source_targets(rows.select("source", "size"), max_rate).withColumnRenamed("source", "s"), "targets")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("_no", F.lit(0).cast("long"))
    else:
        # Equal rows become one row with a number, and that as many rows again, dealt out in parts of 1000.
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
        rows = rows.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(1000).cast("long"))))
        rows = rows.repartition(F.xxhash64("doc_id", "_text", "_lo"))
        rows = rows.withColumn("_no", F.explode(F.sequence("_lo", F.least(F.col("_lo") + 999, F.col("_n") - 1)))).drop("_n", "_lo")
    mixed = rows.join(per, rows["source"].eqNullSafe(per["s"]), "left").drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = unit_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_text"), F.when(F.col("_no") > 0, F.col("_no")))
    mixed = mixed.withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return mixed.withColumn("copies", copies.cast("long")).drop("_text", "_no")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as its copies, all columns kept."""
    plan = mix_plan(docs, keep=docs.columns, **options)
    copy_no = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return plan.filter("copies > 0").withColumn("copy_no", copy_no).select("kept.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(md5(text), 'null') AS h,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::DOUBLE AS ss FROM d GROUP BY source),
ranked AS (SELECT source, ss, ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1 AS w FROM per),
caps AS (SELECT source, ss, w::DOUBLE AS w, {MAX_RATE}::DOUBLE * ss AS cap, {MAX_RATE}::DOUBLE * ss / w AS fill FROM ranked),
lv AS (
  SELECT a.source, a.fill, a.w,
    ((SELECT sum(ss) FROM caps) - coalesce(sum(b.cap), 0)) / ((SELECT sum(w) FROM caps) - coalesce(sum(b.w), 0)) AS level
  FROM caps a LEFT JOIN caps b
    ON b.fill < a.fill OR (b.fill = a.fill AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))
  GROUP BY a.source, a.fill, a.w),
held AS (SELECT (SELECT level FROM lv WHERE level <= fill ORDER BY fill LIMIT 1) AS level),
t AS (SELECT source, ss, least(cap, coalesce((SELECT level FROM held), fill) * w) AS target FROM caps),
r AS (
  SELECT d.doc_id, d.size, t.ss::BIGINT AS source_size, t.target,
    CASE WHEN t.ss > 0 THEN t.target / t.ss ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.h), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM r
"""
