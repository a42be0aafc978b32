"""Registered queries over the provided tables, and their SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.functions.columns import finite, r6, sigmoid, with_scalars
from fdrspark.functions.rng import normal, normal_sql, sphere_sql, unit, unit_sql
from fdrspark.functions.tails import normal_cdf_sql, normal_quantile_sql, normal_two_sided_sql, t_two_sided_sql
from fdrspark.operators import design, forward, marginal, phenotypes, prune, summaries
from fdrspark.operators import pool as pools
from fdrspark.operators import votes as V
from fdrspark.plans import block, explicit, kernels, rivals, selector, studies, tables
from fdrspark.sources import fixtures as fx
from fdrspark.sources import matrix_files
from fdrspark.streaming import sums as streams

QUERIES, SQL = {}, {}
TRUTH = [j for j, _ in fx.PLANTED]
K, P, L, T = 20, 64, 640, 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def R(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE)"


# Design


@query(f"WITH {fx.XS_SQL} SELECT row_id, j, {R('x')} AS x FROM xs")
def standardize(spark, sf):
    return design.standardise(fx.embedding_long(spark, sf)).select("row_id", "j", r6("x").alias("x"))


@query(f"WITH {fx.X_SQL} SELECT row_id, j, {R('(x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 1e-12)')} AS x FROM x WINDOW w AS (PARTITION BY j)")
def standardize_unitvar(spark, sf):
    return design.standardise_unit_variance(fx.embedding_long(spark, sf)).select("row_id", "j", r6("x").alias("x"))


@query(f"""WITH {fx.X_SQL}, g AS (SELECT j, avg(x) AS mean, sqrt(count(*) * var_pop(x)) AS norm, count(*) AS n FROM x GROUP BY j)
SELECT j, {R('mean')} AS mean, {R('CASE WHEN norm / sqrt(n) < 1e-12 THEN 1e-12 * sqrt(n) ELSE norm END')} AS norm, norm / sqrt(n) < 1e-12 AS dropped FROM g""")
def standardize_guarded(spark, sf):
    return design.standardise_guarded(fx.embedding_long(spark, sf)).select("j", r6("mean").alias("mean"), r6("norm").alias("norm"), "dropped")


@query(f"WITH {fx.X_SQL}, xz AS (SELECT row_id, j, CASE WHEN j = 7 THEN 2.5::DOUBLE ELSE x END AS x FROM x), m AS (SELECT j, avg(x) AS m, sqrt(count(*) * var_pop(x)) AS n FROM xz GROUP BY j) SELECT row_id, j, {R('(x - m) / n')} AS x FROM xz JOIN m USING (j) WHERE j <> 7")
def preprocess_drop(spark, sf):
    """A column that doesn't vary is dropped, the others are standardised."""
    return design.preprocess(_flat_column(spark, sf))[0].select("row_id", "j", r6("x").alias("x"))


@query(f"WITH {fx.X_SQL} SELECT row_id, j, {R('CASE WHEN j = 7 THEN 2.5::DOUBLE ELSE x END')} AS x FROM x")
def preprocess_restore(spark, sf):
    """Standardising undone, with the dropped column in its place."""
    return design.restore(*design.preprocess(_flat_column(spark, sf))).select("row_id", "j", r6("x").alias("x"))


def _flat_column(spark, sf):
    return fx.embedding_long(spark, sf).withColumn("x", F.when(F.col("j") == 7, 2.5).otherwise(F.col("x")))


@query(f"SELECT p_partkey FROM part ORDER BY {unit_sql(7, 'p_partkey')}, p_partkey LIMIT (SELECT greatest(1, floor(count(*) * 0.125)::BIGINT) FROM part)")
def run_subsample_share(spark, sf):
    """A share of the runs, given as text."""
    part = fx.table(spark, sf, "part").select("p_partkey")
    return design.pick(part, "p_partkey", design.how_many("1.25e-1", part.count()), 7)


@query("SELECT j, i::INT AS i, x FROM (SELECT unnest(range(64))::INT AS j, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) e JOIN (SELECT unnest([5, 0, 3]) AS vec_id, unnest(range(3)) AS i) r USING (vec_id) WHERE j IN (2, 9)")
def row_column_gather(spark, sf):
    """Three rows, in the order asked for, of two columns."""
    f = design.feature_major(fx.embedding_long(spark, sf).filter("row_id < 10"))
    return matrix_files.gather(f, [5, 0, 3], [2, 9]).select("j", F.posexplode("x").alias("i", "x"))


@query(f"SELECT o_orderkey, {R('o_totalprice - (SELECT avg(o_totalprice) FROM orders)')} AS y FROM orders")
def center_y(spark, sf):
    return design.center(fx.table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", r6("o_totalprice").alias("y"))


CORR_SQL = f"{fx.P_SQL}, corr AS (SELECT j, sum(x * y) AS c FROM xs JOIN y USING (row_id) GROUP BY j)"


def _corr(spark, sf):
    x, y = fx.planted(spark, sf)
    return design.xt_times(x, y), x, y


@query(f"WITH {CORR_SQL} SELECT j, {R('c')} AS c FROM corr")
def gemv_xt(spark, sf):
    return _corr(spark, sf)[0].select("j", r6("c").alias("c"))


@query(f"WITH {fx.XS_SQL}, {fx.BETA_SQL} SELECT row_id, {R('sum(x * b)')} AS v FROM xs JOIN beta USING (j) GROUP BY row_id")
def gemv_xv(spark, sf):
    w = spark.createDataFrame([(j, b) for j, b in fx.PLANTED] + [(0, 0.0)], "j int, w double")
    return design.x_times(design.standardise(fx.embedding_long(spark, sf)), w).select("row_id", r6("v").alias("v"))


@query(f"""WITH {fx.X_SQL}, {fx.BETA_SQL}, m AS (SELECT j, avg(x) AS mean, sqrt(count(*) * var_pop(x)) AS norm FROM x GROUP BY j)
SELECT row_id, {R('sum((x - mean) / norm * b) + 1.5::DOUBLE')} AS prediction FROM x JOIN beta USING (j) JOIN m USING (j) GROUP BY row_id""")
def predict(spark, sf):
    x = fx.embedding_long(spark, sf)
    beta = spark.createDataFrame(list(fx.PLANTED), "j int, beta double")
    return design.predict(x, design.standardise_guarded(x).join(beta, "j"), 1.5).select("row_id", r6("prediction").alias("prediction"))


@query(f"WITH {CORR_SQL} SELECT 'real' AS kind, j AS idx, {R('c')} AS c FROM corr ORDER BY abs(c) DESC, j LIMIT 1")
def argmax_corr(spark, sf):
    w = forward.winner(_corr(spark, sf)[0].select(F.lit("real").alias("kind"), F.col("j").alias("idx"), "c"))
    return w.select("kind", "idx", r6("c").alias("c"))


@query(f"WITH {CORR_SQL} SELECT j, {R('c')} AS c FROM corr WHERE abs(c) >= (SELECT max(abs(c)) FROM corr) * 0.8")
def tie_set(spark, sf):
    c = _corr(spark, sf)[0]
    top = c.agg((F.max(F.abs("c")) * 0.2).alias("e")).first()["e"]
    return forward.tie_set(c, top + 1e-12).select("j", r6("c").alias("c"))


@query(f"""WITH {CORR_SQL}, w AS (SELECT j AS jw, c AS cw FROM corr ORDER BY abs(c) DESC, j LIMIT 1),
a AS (SELECT x.j, sum(x.x * w2.x) * (SELECT sign(cw) FROM w) AS a FROM xs x JOIN (SELECT row_id, x FROM xs, w WHERE j = jw) w2 USING (row_id) GROUP BY x.j),
g AS (SELECT j, abs(cw) AS bc, c, a, CASE WHEN abs(1 - a) > 1e-10 THEN (abs(cw) - c) / (1 - a) END AS t1, CASE WHEN abs(1 + a) > 1e-10 THEN (abs(cw) + c) / (1 + a) END AS t2 FROM corr JOIN a USING (j), w WHERE j <> jw)
SELECT j, {R('least(CASE WHEN t1 > 1e-10 THEN t1 END, CASE WHEN t2 > 1e-10 THEN t2 END)')} AS gamma FROM g""")
def lars_gamma_step1(spark, sf):
    c, x, _ = _corr(spark, sf)
    lead = forward.winner(c.select(F.lit("real").alias("kind"), F.col("j").alias("idx"), "c"))
    column = x.join(F.broadcast(lead.select(F.col("idx").alias("j"))), "j").select("row_id", F.col("x").alias("y"))
    inner = design.xt_times(x, column).withColumnRenamed("c", "a")
    return forward.first_step(c, inner).select("j", r6("gamma").alias("gamma"))


@query(f"""WITH {fx.X_SQL}, n AS (SELECT max(j) + 1 AS p FROM x)
SELECT j, 'real' AS kind, count(*) AS n FROM x GROUP BY j
UNION ALL SELECT (j + p)::INT, 'dummy', count(*) FROM x, n GROUP BY j, p""")
def augment_union(spark, sf):
    f = design.feature_major(fx.embedding_long(spark, sf))
    return design.augment(f, f).select("j", "kind", F.size("x").cast("long").alias("n"))


@query("SELECT vec_id AS row_id, unnest(range(64))::INT AS j, unnest(embedding)::DOUBLE AS x FROM embeddings ORDER BY 1, 2")
def layout_round_trip(spark, sf):
    """Long to feature-major and back; row numbers are those of sorted ids, which here are 0, 1, ..."""
    return design.to_long(design.feature_major(fx.embedding_long(spark, sf)))


# Dosages


G_SQL = "SELECT l_orderkey AS row_id, l_linenumber AS j, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_quantity % 3)::DOUBLE END AS g FROM lineitem"


def _dosages(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("j"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") % 3).alias("g"))


_E = ["n * (1 - q) * (1 - q)", "2 * n * q * (1 - q)", "n * q * q"]


@query(f"""WITH g AS ({G_SQL}), n AS (SELECT count(DISTINCT row_id) AS nr FROM g),
s AS (SELECT j, count(g) AS n, sum(g) / (2.0::DOUBLE * count(g)) AS q, sum((g = 0)::INT) AS n0, sum((g = 1)::INT) AS n1, sum((g = 2)::INT) AS n2 FROM g GROUP BY j),
m AS (SELECT j, least(q, 1 - q) AS maf, n::DOUBLE / nr AS call_rate, {' + '.join(f'(CASE WHEN {e} > 0 THEN (n{k} - {e}) * (n{k} - {e}) / ({e}) ELSE 0 END)' for k, e in enumerate(_E))} AS hwe_chi2 FROM s, n)
SELECT j, {R('maf')} AS maf, {R('call_rate')} AS call_rate, {R('hwe_chi2')} AS hwe_chi2, {R(normal_two_sided_sql('sqrt(hwe_chi2)'))} AS hwe_p, maf >= 0.01 AND call_rate >= 0.3 AND hwe_chi2 <= 23.928 AS passes FROM m""")
def maf_callrate_qc(spark, sf):
    g = _dosages(spark, sf)
    n = g.agg(F.count_distinct("row_id").alias("n")).first()["n"]
    return design.quality_control(g, n, call_rate=0.3).select("j", r6("maf").alias("maf"), r6("call_rate").alias("call_rate"), r6("hwe_chi2").alias("hwe_chi2"), r6("hwe_p").alias("hwe_p"), "passes")


@query("SELECT o_orderkey, least(greatest(round_even(o_totalprice / 100000.0::DOUBLE, 0), 0), 2)::DOUBLE AS g FROM orders")
def recode_dosage(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", design.recode_dosage(F.col("o_totalprice") / 100000.0).alias("g"))


@query(f"""WITH g AS ({G_SQL}), h AS (SELECT row_id, j, 2 - coalesce(g, 0) AS c FROM g)
SELECT row_id, j, CASE c WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.2::DOUBLE ELSE 1.2::DOUBLE * 1.2::DOUBLE END AS rr FROM h""")
def relative_risk(spark, sf):
    return phenotypes.relative_risks(_dosages(spark, sf), 1.2, risk_allele=0)


@query("""WITH s AS (SELECT o_orderpriority AS chrom, o_custkey AS iid, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2),
have AS (SELECT iid FROM s GROUP BY iid HAVING count(DISTINCT chrom) = (SELECT count(DISTINCT chrom) FROM s)),
r AS (SELECT iid, row_number() OVER (ORDER BY pos) AS rank FROM s WHERE chrom = (SELECT min(chrom) FROM s) AND iid IN (SELECT iid FROM have))
SELECT chrom, iid, pos, rank::INT AS rank FROM s JOIN r USING (iid)""")
def sample_intersection(spark, sf):
    o = fx.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("chrom"), F.col("o_custkey").alias("iid")).agg(F.min("o_orderkey").alias("pos"))
    return design.common_samples(o)


@query("""WITH s AS (SELECT o_orderpriority AS chrom, o_custkey AS iid FROM orders GROUP BY 1, 2)
SELECT chrom, count(*) AS n, count(*) <> (SELECT count(DISTINCT iid) FROM s) AS mismatch FROM s GROUP BY chrom""")
def sample_mismatch(spark, sf):
    s = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("chrom"), F.col("o_custkey").alias("iid")).distinct()
    return with_scalars(s.groupBy("chrom").agg(F.count("*").alias("n")), s.agg(F.count_distinct("iid").alias("_a"))).select("chrom", "n", (F.col("n") != F.col("_a")).alias("mismatch"))


@query(f"SELECT p_partkey FROM part ORDER BY {unit_sql(7, 'p_partkey')}, p_partkey LIMIT 25")
def column_subsample(spark, sf):
    return design.pick(fx.table(spark, sf, "part").select("p_partkey"), "p_partkey", 25, 7)


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {unit_sql(5, 'o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.375) THEN 'screen' ELSE 'inference' END AS part FROM r""")
def stratified_split(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return design.stratified_split(o, "o_orderkey", "o_orderstatus", 0.375, 5)


@query(f"SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY -ln(1.0::DOUBLE - {unit_sql(3, 'c_custkey')}) / c_acctbal, c_custkey LIMIT 40")
def weighted_cases(spark, sf):
    return design.weighted_sample(fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 40, 3).select("c_custkey")


# Tests


CA_SQL = f"""{fx.B_SQL},
b AS (SELECT count(*)::DOUBLE AS n, sum(y) AS n1 FROM lab),
s AS (SELECT j, sum(g) AS sx, sum(g * g) AS sxx, sum(g * y) AS sxy FROM g JOIN lab USING (row_id) GROUP BY j),
ca AS (SELECT j, (sxy - n1 / n * sx) / sqrt(greatest(n1 * (n - n1) / (n * (n - 1)) * (n * sxx - sx * sx) / n, 1e-20)) AS z FROM s, b)"""


def _trend(spark, sf):
    return marginal.trend_test(*fx.text_dosages(spark, sf))


@query(f"WITH {CA_SQL} SELECT j, {R('z')} AS z, {R(normal_two_sided_sql('z'))} AS p FROM ca")
def ca_test(spark, sf):
    return marginal.with_p(_trend(spark, sf), "z").select("j", r6("z").alias("z"), r6("p").alias("p"))


@query(f"WITH {CA_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM lab) SELECT j, {R('z / sqrt(n)')} AS z FROM ca, n")
def ca_test_unscaled(spark, sf):
    """The trend test with the variance that leaves out the last division by n."""
    return marginal.trend_test(*fx.text_dosages(spark, sf), scaled=False).select("j", r6("z").alias("z"))


MT_SQL = f"""{fx.P_SQL},
mr AS (SELECT j, least(greatest(corr(x, y), -1 + 1e-10), 1 - 1e-10) AS r, count(*) - 2 AS df FROM xs JOIN y USING (row_id) GROUP BY j),
mt AS (SELECT j, r, r * sqrt(df / (1 - r * r)) AS t, df FROM mr),
mp AS (SELECT j, t, {t_two_sided_sql('t', 'df')} AS p FROM mt)"""


def _marginal(spark, sf):
    return marginal.marginal_regression(*fx.planted(spark, sf))


@query(f"WITH {MT_SQL} SELECT j, {R('r')} AS r, {R('t')} AS t, df FROM mt")
def marginal_t(spark, sf):
    return _marginal(spark, sf).select("j", r6("r").alias("r"), r6("t").alias("t"), "df")


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, unnest(['quantity', 'discount', 'tax']) AS j, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem),
m AS (SELECT j, corr(x, y) AS r, count(*) - 2 AS df FROM l GROUP BY j) SELECT j, {R('r')} AS r, {R('r * sqrt(df / (1 - r * r))')} AS t, df FROM m""")
def marginal_t_lineitem(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumn("row_id", F.struct("l_orderkey", "l_linenumber"))
    cols = F.explode(F.array(*[F.struct(F.lit(n).alias("j"), F.col(f"l_{n}").alias("x")) for n in ("quantity", "discount", "tax")]))
    both = li.select("row_id", F.col("l_extendedprice").alias("y"), cols.alias("s")).select("s.j", "s.x", "y")
    r = F.col("r")
    return both.groupBy("j").agg(F.corr("x", "y").alias("r"), (F.count("*") - 2).alias("df")).select("j", r6("r").alias("r"), r6(r * F.sqrt(F.col("df") / (1 - r * r))).alias("t"), "df")


def _up_sql(dependent: bool) -> str:
    h = "list_sum([1.0::DOUBLE / i FOR i IN range(1, m + 1)])" if dependent else "1.0::DOUBLE"
    return f"""WITH {MT_SQL}, k AS (SELECT j, p, row_number() OVER (ORDER BY p, j) AS rank, count(*) OVER () AS m FROM mp),
c AS (SELECT coalesce(max(rank), 0) AS kk FROM k WHERE p <= rank * 0.1::DOUBLE / (m * {h})) SELECT j, {R('p')} AS p, rank, rank <= kk AS reject FROM k, c"""


def _up(spark, sf, dependent):
    d = marginal.with_p(_marginal(spark, sf), "t", "df").select("j", "p")
    return marginal.step_up(d, 0.1, dependent).select("j", r6("p").alias("p"), "rank", "reject")


@query(_up_sql(False))
def bh(spark, sf):
    return _up(spark, sf, False)


@query(_up_sql(True))
def by(spark, sf):
    return _up(spark, sf, True)


@query(f"WITH {CA_SQL} SELECT j FROM (SELECT j, z FROM ca ORDER BY {R('abs(z)')} DESC, j LIMIT 20)")
def screen_topk(spark, sf):
    d = _trend(spark, sf).select("j", (-r6(F.abs("z"))).alias("p"))
    return marginal.screen(d, 20).select("j")


KO_SQL = f"""{CORR_SQL}, xk AS (SELECT row_id, j, {normal_sql(9, 'row_id', 'j')} AS x FROM x),
w AS (SELECT j, abs(c) - abs(ck) AS w FROM corr JOIN (SELECT j, sum(x * y) AS ck FROM xk JOIN y USING (row_id) GROUP BY j) USING (j))"""


def _knockoffs(spark, sf):
    c, x, y = _corr(spark, sf)
    fake = x.select("row_id", "j", normal(9, F.col("row_id"), F.col("j")).alias("x"))
    return c.join(design.xt_times(fake, y).withColumnRenamed("c", "ck"), "j").select("j", (F.abs("c") - F.abs("ck")).alias("w"))


@query(f"""WITH {KO_SQL}, t AS (SELECT DISTINCT abs(w) AS t FROM w WHERE w <> 0),
ok AS (SELECT t FROM t, w GROUP BY t HAVING (1 + sum((w <= -t)::INT))::DOUBLE / greatest(1, sum((w >= t)::INT)) <= 0.5)
SELECT j, {R('w')} AS w, w >= coalesce((SELECT min(t) FROM ok), 'inf'::DOUBLE) AS selected FROM w""")
def knockoff_plus(spark, sf):
    return marginal.knockoff_select(_knockoffs(spark, sf), 0.5).select("j", r6("w").alias("w"), "selected")


@query(f"""WITH {fx.P_SQL}, z AS (SELECT row_id, sum(CASE j WHEN 3 THEN x END) AS a, sum(CASE j WHEN 10 THEN x END) AS b FROM xs WHERE j IN (3, 10) GROUP BY row_id),
s AS (SELECT sum(a * a) aa, sum(a * b) ab, sum(b * b) bb, sum(a * y) ay, sum(b * y) yb, sum(y * y) yy, count(*) n FROM z JOIN y USING (row_id)),
e AS (SELECT *, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS b1, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s)
SELECT {R('b1')} AS b1, {R('b2')} AS b2, {R('yy - b1 * ay - b2 * yb')} AS rss FROM e""")
def ols_2col(spark, sf):
    x, y = fx.planted(spark, sf)
    z = x.filter(F.col("j").isin(3, 10)).groupBy("row_id").agg(F.sum(F.when(F.col("j") == 3, F.col("x"))).alias("a"), F.sum(F.when(F.col("j") == 10, F.col("x"))).alias("b")).join(y, "row_id")
    s = z.agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("aa", "ab", "bb", "ay", "by", "yy")])
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    b1, b2 = (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det, (F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det
    return s.select(r6(b1).alias("b1"), r6(b2).alias("b2"), r6(F.col("yy") - b1 * F.col("ay") - b2 * F.col("by")).alias("rss"))


@query(f"""WITH {fx.XS_SQL}, v AS (SELECT vec_id AS row_id, (label = 0)::INT::DOUBLE AS y FROM embeddings)
SELECT j, {R('sum(x * (y - 0.5::DOUBLE))')} AS score, {R('sum(x * x * 0.25::DOUBLE)')} AS information FROM xs JOIN v USING (row_id) GROUP BY j""")
def irls_step1(spark, sf):
    x = design.standardise(fx.embedding_long(spark, sf))
    y = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("double").alias("y"))
    p = sigmoid(F.lit(0.0))
    return x.join(y, "row_id").groupBy("j").agg(r6(F.sum(F.col("x") * (F.col("y") - p))).alias("score"), r6(F.sum(F.col("x") * F.col("x") * p * (1 - p))).alias("information"))


@query(f"""WITH {fx.P_SQL}, steps AS (SELECT unnest([3, 10, 20, 40, 50]) AS j, unnest(range(1, 6)) AS step),
f AS (SELECT s.step, x.row_id, sum(x.x * b.b) AS f FROM steps s JOIN steps u ON u.step <= s.step JOIN xs x ON x.j = u.j JOIN beta b ON b.j = u.j GROUP BY 1, 2),
r AS (SELECT step, sum((y - f) * (y - f)) AS rss, step AS dof, count(*) AS n, sum(y * y) AS ssy FROM f JOIN y USING (row_id) GROUP BY step),
l AS (SELECT rss / (n - dof) AS s2 FROM r ORDER BY step DESC LIMIT 1)
SELECT step::INT AS step, {R('rss')} AS rss, {R('1 - rss / ssy')} AS r2, {R('rss / s2 - n + 2 * dof')} AS cp, dof::INT AS dof FROM r, l""")
def rss_r2_cp(spark, sf):
    x, y = fx.planted(spark, sf)
    rows = [(s + 1, j, b) for s in range(5) for j, b in fx.PLANTED[: s + 1]]
    path = spark.createDataFrame(rows, "step int, j int, b double")
    f = x.join(F.broadcast(path), "j").groupBy("step", "row_id").agg(F.sum(F.col("x") * F.col("b")).alias("f")).join(y, "row_id")
    d = F.col("y") - F.col("f")
    s = f.groupBy("step").agg(F.sum(d * d).alias("rss"), F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("ssy")).withColumn("dof", F.col("step"))
    return forward.fit_statistics(s).select("step", r6("rss").alias("rss"), r6("r2").alias("r2"), r6("cp").alias("cp"), "dof")


# Correlated columns


LD_SQL = f"""{fx.XS_SQL}, ld AS (SELECT a.j AS j1, b.j AS j2, sum(a.x * b.x) AS r FROM xs a JOIN xs b ON a.row_id = b.row_id AND a.j < b.j GROUP BY 1, 2),
edge AS (SELECT j1, j2, r FROM ld WHERE abs(r) > 0.1)"""


def _edges(spark, sf, threshold=0.1):
    return prune.edges(fx.table(spark, sf, "embeddings").select(F.col("embedding").alias("x")), P, threshold)


@query(f"WITH {LD_SQL} SELECT j1, j2, {R('r')} AS r FROM edge")
def ld_edges(spark, sf):
    return _edges(spark, sf).select("j1", "j2", r6("r").alias("r"))


@query(f"WITH {LD_SQL} SELECT j1, j2, {R('r')} AS r FROM edge")
def ld_edges_blocked(spark, sf):
    f = design.feature_major(design.standardise(fx.embedding_long(spark, sf)))
    return prune.block_edges(f, 0.1, block=24).select("j1", "j2", r6("r").alias("r"))


CC_SQL = f"""WITH RECURSIVE {LD_SQL}, e2 AS (SELECT j1 AS a, j2 AS b FROM edge UNION ALL SELECT j2, j1 FROM edge),
reach AS (SELECT j, j AS r FROM xm UNION SELECT reach.j, e2.b FROM reach JOIN e2 ON reach.r = e2.a),
cl AS (SELECT j, min(r) AS cluster FROM reach GROUP BY j)"""


def _clusters(spark, sf):
    return prune.clusters(spark.range(P).select(F.col("id").cast("int").alias("j")), _edges(spark, sf))


@query(f"{CC_SQL} SELECT j, cluster FROM cl")
def ld_components(spark, sf):
    return _clusters(spark, sf)


@query(f"{CC_SQL} SELECT cluster, min(j) AS j, count(*) AS size FROM cl GROUP BY cluster")
def ld_representatives(spark, sf):
    return prune.representatives(_clusters(spark, sf))


@query(f"{CC_SQL} SELECT cluster, arg_min(j, {unit_sql(4, 'j')}) AS j, count(*) AS size FROM cl GROUP BY cluster")
def ld_random_representatives(spark, sf):
    return prune.representatives(_clusters(spark, sf), "random", 4)


@query(f"WITH {LD_SQL} SELECT {R('max(abs(r))')} AS max_abs_corr FROM ld")
def max_abs_corr(spark, sf):
    c = prune.correlations(fx.table(spark, sf, "embeddings").select(F.col("embedding").alias("x")), P)
    return c.agg(r6(F.max(F.abs("r"))).alias("max_abs_corr"))


# The pool


def _n(spark, sf) -> int:
    return fx.table(spark, sf, "embeddings").count()


KD_SQL = "kd AS (SELECT k::INT AS k, d::INT AS d FROM range(4) a(k), range(200) b(d)), n AS (SELECT count(*) AS n FROM embeddings)"
ROW0_SQL = f"{KD_SQL}, r0 AS (SELECT k, d, {sphere_sql('(SELECT n FROM n) - 2', 11, 'k', 'd', 0)} AS a0 FROM kd), p0 AS (SELECT k, d, a0, greatest(1 - a0 * a0, 0) AS stick FROM r0)"
ROW1_SQL = f"{ROW0_SQL}, r1 AS (SELECT *, sqrt(stick) * {sphere_sql('(SELECT n FROM n) - 3', 11, 'k', 'd', 1)} AS a1 FROM p0)"


@query(f"WITH {ROW0_SQL} SELECT k, d, {R('a0')} AS a0, {R('stick')} AS stick FROM p0")
def vd_pool_row0(spark, sf):
    return pools.first_row(pools.pool(spark, 4, 200), _n(spark, sf), 11).select("k", "d", r6("a0").alias("a0"), r6("stick").alias("stick"))


@query(f"WITH {ROW1_SQL} SELECT k, d, {R('a1')} AS a1, {R('greatest(stick - a1 * a1, 0)')} AS stick FROM r1")
def vd_pool_extend(spark, sf):
    n = _n(spark, sf)
    return pools.extend(pools.first_row(pools.pool(spark, 4, 200), n, 11), n, 1, 11).select("k", "d", r6("a1").alias("a1"), r6("stick").alias("stick"))


@query(f"WITH {KD_SQL} SELECT k, d, {R(normal_sql(11, 'k', 'd', 0) + ' / sqrt((SELECT n FROM n)::DOUBLE)')} AS a0 FROM kd")
def vd_pool_gaussian(spark, sf):
    return pools.first_row(pools.pool(spark, 4, 200), _n(spark, sf), 11, spherical=False).select("k", "d", r6("a0").alias("a0"))


FIRST_SQL = f"{fx.P_SQL}, {ROW0_SQL}, ny AS (SELECT sqrt(sum(y * y)) AS ny FROM y)"


def _pool_corr(spark, sf):
    c, _, y = _corr(spark, sf)
    pool = pools.first_row(pools.pool(spark, 4, 200), _n(spark, sf), 11)
    return c, with_scalars(pool, y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))).select("k", "d", (F.col("a0") * F.col("ny")).alias("c"))


@query(f"WITH {FIRST_SQL} SELECT k, d, {R('a0 * ny')} AS c FROM p0, ny")
def vd_corr_init(spark, sf):
    return _pool_corr(spark, sf)[1].select("k", "d", r6("c").alias("c"))


@query(f"""WITH {FIRST_SQL}, corr AS (SELECT j, sum(x * y) AS c FROM xs JOIN y USING (row_id) GROUP BY j),
a AS (SELECT k, 'dummy' AS kind, d AS idx, a0 * ny AS c FROM p0, ny UNION ALL SELECT DISTINCT k, 'real', j, c FROM kd, corr),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(c) DESC, kind, idx) AS o FROM a) SELECT k, kind, idx, {R('c')} AS c FROM r WHERE o = 1""")
def dummy_vs_real_first(spark, sf):
    c, pool = _pool_corr(spark, sf)
    one = lambda d, kind, idx: d.groupBy("k").agg(F.max_by(F.struct(F.lit(kind).alias("kind"), F.col(idx).alias("idx"), "c"), F.struct(F.abs("c").alias("x"), (-F.col(idx)).alias("y"))).alias("w"))
    null = one(pool, "dummy", "d").select("k", "w.*")
    real = with_scalars(null.select("k"), forward.winner(c.select(F.lit("real").alias("kind"), F.col("j").alias("idx"), "c")))
    best = null.unionByName(real).groupBy("k").agg(F.max_by(F.struct("kind", "idx", "c"), F.struct(F.abs("c").alias("x"), (F.col("kind") == "dummy").cast("int").alias("y"))).alias("w"))
    return best.select("k", "w.kind", "w.idx", r6("w.c").alias("c"))


# Votes; entry events are hashed: experiment k takes column j after t0 dummies, early for the planted ones


_T0 = f"CASE WHEN j IN ({', '.join(map(str, TRUTH))}) THEN floor({unit_sql(1, 'k', 'j')} * 2) ELSE floor(pow({unit_sql(1, 'k', 'j')}, 0.5::DOUBLE) * 60) END::INT"
VOTE_SQL = f"""en AS (SELECT k::INT AS k, j::INT AS j, {_T0} AS t0 FROM range({K}) a(k), range({P}) b(j)),
ts AS (SELECT unnest(range(1, {T + 1}))::INT AS t),
phi AS (SELECT t, j, count(*) / {K}.0::DOUBLE AS phi FROM en JOIN ts ON t0 < t GROUP BY t, j)"""
DPHI_SQL = f"{VOTE_SQL}, dphi AS (SELECT a.t, a.j, a.phi, a.phi - coalesce(b.phi, 0) AS dphi FROM phi a LEFT JOIN phi b ON b.j = a.j AND b.t = a.t - 1)"
PP_SQL = f"""{DPHI_SQL}, av AS (SELECT t AS s, sum(phi) AS av FROM phi GROUP BY t),
dd AS (SELECT h.t AS h, d.t AS s, sum(d.dphi) AS dd FROM phi h JOIN dphi d ON d.j = h.j AND d.t <= h.t WHERE h.phi > 0.5 GROUP BY 1, 2),
sc AS (SELECT h, s, CASE WHEN dd > 1e-12 AND {L} - s + 1 > 0 THEN 1.0::DOUBLE - ({P} - av) / ({L} - s + 1.0::DOUBLE) / dd ELSE 0 END AS sc FROM dd JOIN av USING (s)),
pp AS (SELECT phi.t, phi.j, any_value(phi.phi) AS phi, coalesce(sum(d.dphi * sc.sc), 0) AS phi_prime FROM phi LEFT JOIN dphi d ON d.j = phi.j AND d.t <= phi.t LEFT JOIN sc ON sc.h = phi.t AND sc.s = d.t GROUP BY phi.t, phi.j)"""
GRID_SQL = f"grid AS (SELECT i::INT AS v_idx, 0.5::DOUBLE + i / {K}.0::DOUBLE AS v FROM range({K // 2}) r(i) UNION ALL SELECT {K // 2}, 1.0::DOUBLE - 1e-12::DOUBLE)"
FDP_SQL = f"""{PP_SQL}, {GRID_SQL}, sf AS (SELECT t, v_idx, v, coalesce(least(1.0::DOUBLE, sum(1 - phi_prime) FILTER (phi > v) / count(*) FILTER (phi > v)), 0) AS fdp_hat, count(*) FILTER (phi > v) AS r
FROM ts CROSS JOIN grid LEFT JOIN pp USING (t) GROUP BY t, v_idx, v)"""
BEST_SQL = f"{FDP_SQL}, best AS (SELECT * FROM sf WHERE fdp_hat <= 0.1 ORDER BY r DESC, v_idx DESC, t DESC LIMIT 1)"


def _events(spark):
    u = unit(1, F.col("k"), F.col("j"))
    t0 = F.when(F.col("j").isin(TRUTH), F.floor(u * 2)).otherwise(F.floor(F.pow(u, 0.5) * 60)).cast("int")
    return spark.range(K * P).select(F.floor(F.col("id") / P).cast("int").alias("k"), (F.col("id") % P).cast("int").alias("j")).withColumn("t0", t0)


def _phi(spark):
    return V.votes(_events(spark), K, T)


def _surface(spark):
    phi = V.deflated(_phi(spark), P, L)
    return V.fdp_surface(phi, V.voting_grid(spark, K), spark.range(1, T + 1).select(F.col("id").cast("int").alias("t"))), phi


@query(f"WITH {GRID_SQL} SELECT v_idx, v FROM grid")
def voting_grid(spark, sf):
    return V.voting_grid(spark, K)


@query(f"WITH {VOTE_SQL} SELECT t, j, {R('phi')} AS phi FROM phi")
def vote_phi(spark, sf):
    return _phi(spark).select("t", "j", r6("phi").alias("phi"))


@query(f"WITH {VOTE_SQL} SELECT t, {R('sum(phi)')} AS av, count(*) FILTER (phi > 0.5) AS n_above FROM phi GROUP BY t")
def vote_totals(spark, sf):
    return _phi(spark).groupBy("t").agg(r6(F.sum("phi")).alias("av"), F.count(F.when(F.col("phi") > 0.5, 1)).alias("n_above"))


@query(f"WITH {DPHI_SQL} SELECT t, j, {R('dphi')} AS dphi FROM dphi")
def phi_diff(spark, sf):
    return V.increments(_phi(spark)).select("t", "j", r6("dphi").alias("dphi"))


@query(f"WITH {PP_SQL} SELECT t, j, {R('phi_prime')} AS phi_prime FROM pp")
def phi_prime(spark, sf):
    return V.deflated(_phi(spark), P, L).select("t", "j", r6("phi_prime").alias("phi_prime"))


@query(f"WITH {FDP_SQL} SELECT t, v_idx, {R('v')} AS v, {R('fdp_hat')} AS fdp_hat, r FROM sf")
def fdp_hat(spark, sf):
    return _surface(spark)[0].select("t", "v_idx", r6("v").alias("v"), r6("fdp_hat").alias("fdp_hat"), "r")


@query(f"WITH {BEST_SQL} SELECT phi.j, {R('phi.phi')} AS phi, {R('best.v')} AS v, best.t FROM phi JOIN best ON phi.t = best.t AND phi.phi > best.v")
def select_tv(spark, sf):
    s, phi = _surface(spark)
    return V.selection(phi, V.best_cell(s, 0.1)).select("j", r6("phi").alias("phi"), r6("v").alias("v"), "t")


@query(f"WITH {FDP_SQL} SELECT t, v_idx, {R('v')} AS v, r FROM sf WHERE t = {T} AND fdp_hat <= 0.3 ORDER BY r DESC, v_idx DESC LIMIT 1")
def select_v(spark, sf):
    s, _ = _surface(spark)
    return V.best_cell(s.filter(F.col("t") == T), 0.3).select("t", "v_idx", r6("v").alias("v"), "r")


@query(f"""WITH {FDP_SQL}, al AS (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.3])::DOUBLE AS alpha)
SELECT alpha, t, coalesce(min(v_idx) FILTER (fdp_hat <= alpha), -1)::INT AS v_idx FROM sf, al GROUP BY alpha, t""")
def vstar(spark, sf):
    al = spark.createDataFrame([(a,) for a in (0.01, 0.05, 0.1, 0.2, 0.3)], "alpha double")
    return V.least_feasible(_surface(spark)[0], al)


@query(f"""WITH {FDP_SQL}, top AS (SELECT t, arg_max(fdp_hat, v_idx) AS f FROM sf GROUP BY t),
ab AS (SELECT top.t, f, (SELECT count(*) FROM phi WHERE phi.t = top.t AND phi > 0.5) AS n FROM top),
g AS (SELECT t, f, n > coalesce(lag(n) OVER (ORDER BY t), 0) AS grew FROM ab),
i AS (SELECT t, f, grew, sum(grew::INT) OVER (ORDER BY t) AS island FROM g),
s AS (SELECT t, f, sum((NOT grew)::INT) OVER (PARTITION BY island ORDER BY t) AS stale FROM i)
SELECT coalesce(min(t) FILTER (f > 0.1 OR stale >= 3), {T})::INT AS t_stop FROM s""")
def stopping_time(spark, sf):
    s, phi = _surface(spark)
    above = phi.filter("phi > 0.5").groupBy("t").agg(F.count("*").alias("n_above"))
    return V.stopping_time(s, above, 0.1, 1, 3, T)


@query(f"""WITH {VOTE_SQL}, tr AS (SELECT unnest([{', '.join(map(str, TRUTH))}]) AS j), s AS (SELECT t, j FROM phi WHERE phi > 0.5)
SELECT t, count(*) AS n_selected, {R('count(*) FILTER (j NOT IN (SELECT j FROM tr))::DOUBLE / count(*)')} AS fdp, {R('count(*) FILTER (j IN (SELECT j FROM tr)) / 5.0::DOUBLE')} AS tpp FROM s GROUP BY t""")
def fdp_tpp(spark, sf):
    truth = spark.createDataFrame([(j,) for j in TRUTH], "j int")
    return V.fdp_tpp(_phi(spark).filter("phi > 0.5").select("t", "j"), truth, ["t"]).select("t", "n_selected", r6("fdp").alias("fdp"), r6("tpp").alias("tpp"))


@query(f"WITH {VOTE_SQL} SELECT k, j FROM en WHERE t0 >= {T}")
def unused_by_horizon(spark, sf):
    """Columns that an experiment has not taken by the last horizon: an anti join."""
    e = _events(spark)
    return e.select("k", "j").join(e.filter(F.col("t0") < T).select("k", "j"), ["k", "j"], "left_anti")


@query(f"""WITH {VOTE_SQL} SELECT k, j, t0 AS entry_step, row_number() OVER (PARTITION BY k ORDER BY t0, j)::INT AS entry_pos FROM en""")
def entry_order(spark, sf):
    w = Window.partitionBy("k").orderBy("t0", "j")
    return _events(spark).select("k", "j", F.col("t0").alias("entry_step"), F.row_number().over(w).alias("entry_pos"))


# Summaries


RES_SQL = "res AS (SELECT user_id AS run, event_type AS method, CASE WHEN event_id % 17 = 0 THEN 'failed' END AS error, value % 1 AS fdp, (value * 3) % 1 AS tpp, floor(value)::DOUBLE AS n_disc, value / 10 AS runtime_s, value * 2 AS peak_rss_mb FROM events)"


def _results(spark, sf):
    v = F.col("value")
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("method"), F.when(F.col("event_id") % 17 == 0, "failed").alias("error"), (v % 1).alias("fdp"), (v * 3 % 1).alias("tpp"), F.floor(v).cast("double").alias("n_disc"), (v / 10).alias("runtime_s"), (v * 2).alias("peak_rss_mb"), F.lit(1).alias("n"), F.lit(2).alias("p"))


_MEANS = ["mean_fdp", "std_fdp", "mean_tpp", "std_tpp", "mean_disc", "mean_runtime_s", "mean_peak_rss_mb"]


@query(f"""WITH {RES_SQL} SELECT method, count(*) FILTER (error IS NULL) AS n_runs, count(*) FILTER (error IS NOT NULL) AS n_errors,
{', '.join(f"{R(f'{f}({c}) FILTER (error IS NULL)')} AS {a}" for a, f, c in zip(_MEANS, ['avg', 'stddev_pop', 'avg', 'stddev_pop', 'avg', 'avg', 'avg'], ['fdp', 'fdp', 'tpp', 'tpp', 'n_disc', 'runtime_s', 'peak_rss_mb']))},
avg(fdp) FILTER (error IS NULL) <= 0.505 AS fdr_controlled FROM res GROUP BY method""")
def method_summary(spark, sf):
    s = summaries.method_summary(_results(spark, sf), 0.5)
    return s.select("method", "n_runs", "n_errors", *[r6(c).alias(c) for c in _MEANS], "fdr_controlled")


METHODS = ["click", "purchase", "view"]


@query(f"""WITH {RES_SQL}, one AS (SELECT run, method, max(fdp) AS fdp, max(tpp) AS tpp FROM res GROUP BY run, method)
SELECT run, 1 AS n, 2 AS p, {', '.join(f"{R(f"max({m}) FILTER (method = '{x}')")} AS {x}_{m}" for x in METHODS for m in ('fdp', 'tpp'))} FROM one GROUP BY run""")
def per_run_pivot(spark, sf):
    one = _results(spark, sf).groupBy("run", "method").agg(F.max("fdp").alias("fdp"), F.max("tpp").alias("tpp"), F.first("n").alias("n"), F.first("p").alias("p"))
    w = summaries.per_run(one, METHODS, ["fdp", "tpp"])
    return w.select("run", "n", "p", *[r6(f"{x}_{m}").alias(f"{x}_{m}") for x in METHODS for m in ("fdp", "tpp")])


def _prices(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), ((F.col("o_totalprice") - 100000) / 50000).alias("x"))


PRICE_SQL = "pr AS (SELECT o_orderkey AS id, o_orderpriority AS grp, (o_totalprice - 100000) / 50000 AS x FROM orders)"


@query(f"WITH {PRICE_SQL}, r AS (SELECT grp, abs(x) AS x, row_number() OVER (PARTITION BY grp ORDER BY abs(x) DESC, id) AS rank FROM pr) SELECT grp, rank::INT AS rank, {R('x')} AS x FROM r WHERE rank <= 5")
def order_stats(spark, sf):
    return summaries.order_statistics(_prices(spark, sf), 5).select("grp", "rank", r6("x").alias("x"))


@query(f"WITH {PRICE_SQL} SELECT id, {R('x')} AS x, {R('row_number() OVER (ORDER BY x, id)::DOUBLE / count(*) OVER ()')} AS f FROM pr")
def ecdf(spark, sf):
    return summaries.ecdf(_prices(spark, sf)).select("id", r6("x").alias("x"), r6("f").alias("f"))


@query(f"""WITH {PRICE_SQL}, q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q),
a AS (SELECT quantile_cont(x, [0.05, 0.25, 0.5, 0.75, 0.95]) AS v FROM pr), b AS (SELECT quantile_cont(c_acctbal, [0.05, 0.25, 0.5, 0.75, 0.95]) AS v FROM customer)
SELECT q.q, {R('a.v[i]')} AS qa, {R('b.v[i]')} AS qb FROM (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q, unnest(range(1, 6)) AS i) q, a, b""")
def qq(spark, sf):
    b = fx.table(spark, sf, "customer").select(F.col("c_acctbal").alias("x"))
    return summaries.quantile_pairs(_prices(spark, sf), b, [0.05, 0.25, 0.5, 0.75, 0.95]).select("q", r6("qa").alias("qa"), r6("qb").alias("qb"))


@query(f"""WITH {PRICE_SQL}, r AS (SELECT x, row_number() OVER (ORDER BY x, id) AS i, count(*) OVER () AS n FROM pr)
SELECT max(n) AS n, {R(f"max(greatest(i::DOUBLE / n - {normal_cdf_sql('x')}, {normal_cdf_sql('x')} - (i - 1)::DOUBLE / n))")} AS ks FROM r""")
def ks_normal(spark, sf):
    return summaries.ks_normal(_prices(spark, sf)).select("n", r6("ks").alias("ks"))


@query(f"WITH {PRICE_SQL}, r AS (SELECT x, row_number() OVER (ORDER BY x, id) AS i, count(*) OVER () AS n FROM pr) SELECT any_value(n) AS n, {R('avg(abs(x - ' + normal_quantile_sql('((i - 0.5::DOUBLE) / n)') + '))')} AS w1 FROM r")
def w1_normal(spark, sf):
    return summaries.w1_normal(_prices(spark, sf)).select("n", r6("w1").alias("w1"))


@query(f"WITH {PRICE_SQL} SELECT grp, {R('avg(x)')} AS mean, {R('quantile_cont(x, 0.01)')} AS q0, {R('quantile_cont(x, 0.5)')} AS q1, {R('quantile_cont(x, 0.99)')} AS q2 FROM pr GROUP BY grp")
def bands(spark, sf):
    return summaries.bands(_prices(spark, sf)).select("grp", *[r6(c).alias(c) for c in ("mean", "q0", "q1", "q2")])


@query(f"WITH {fx.XS_SQL} SELECT j, {R('max(abs(x))')} AS max_abs FROM xs GROUP BY j")
def delocalisation(spark, sf):
    return design.standardise(fx.embedding_long(spark, sf)).groupBy("j").agg(r6(F.max(F.abs("x"))).alias("max_abs"))


@query(f"WITH {fx.XS_SQL}, {fx.BETA_SQL}, s AS (SELECT row_id, sum(x * b) AS s FROM xs JOIN beta USING (j) GROUP BY row_id) SELECT {R('sqrt(var_pop(s) / 2)')} AS sd, {R('sqrt(sum(s * s)) / (2 * sqrt(count(*)))')} AS sd_by_norm FROM s")
def snr_noise(spark, sf):
    w = spark.createDataFrame(list(fx.PLANTED), "j int, w double")
    s = design.x_times(design.standardise(fx.embedding_long(spark, sf)), w).withColumnRenamed("v", "s")
    return summaries.noise_scale(s, 2.0).select(r6("sd").alias("sd"), r6("sd_by_norm").alias("sd_by_norm"))


@query("SELECT o_orderkey, (o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))::DOUBLE AS y FROM orders")
def binarize(spark, sf):
    o = fx.table(spark, sf, "orders")
    return with_scalars(o, o.agg(F.percentile("o_totalprice", F.lit(0.5)).alias("_m"))).select("o_orderkey", (F.col("o_totalprice") > F.col("_m")).cast("double").alias("y"))


@query("SELECT count(DISTINCT toxic) <= 2 AS toxic, count(DISTINCT doc_id) <= 2 AS doc_id FROM labels")
def is_binary(spark, sf):
    return fx.table(spark, sf, "labels").agg(*[(F.count_distinct(c) <= 2).alias(c) for c in ("toxic", "doc_id")])


@query("SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS x FROM orders) WHERE NOT isnan(x) AND NOT isinf(x)")
def finite_filter(spark, sf):
    x = fx.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"))
    return x.filter(finite("x")).agg(F.count("*").alias("n"))


# Phenotypes


RISK_SQL = f"""{fx.B_SQL}, cols AS (SELECT DISTINCT j FROM g), ca AS (SELECT j FROM cols ORDER BY {unit_sql(6, 'j')}, j LIMIT 10),
cc AS (SELECT j, ln(1.05::DOUBLE + (1.25 - 1.05)::DOUBLE * {unit_sql(6, "'h'", 'j')}) AS l, {unit_sql(6, "'a'", 'j')} < 0.5 AS flip FROM ca),
pa AS (SELECT row_id, sum(CASE WHEN flip THEN -g * l ELSE g * l END) AS l FROM g JOIN cc USING (j) GROUP BY row_id),
risk AS (SELECT lab.row_id, exp(coalesce(pa.l, 0) + (SELECT coalesce(sum(CASE WHEN flip THEN 2 * l ELSE 0 END), 0) FROM cc)) AS risk FROM lab LEFT JOIN pa USING (row_id))"""


def _risk(spark, sf):
    g, lab = fx.text_dosages(spark, sf)
    causal = phenotypes.causal_columns(g.select("j").distinct(), 10, 6)
    return phenotypes.risk_scores(lab, g, causal, 6)


@query(f"WITH {RISK_SQL} SELECT row_id, {R('risk')} AS risk FROM risk")
def phenotype_risk(spark, sf):
    return _risk(spark, sf).select("row_id", r6("risk").alias("risk"))


@query(f"""WITH {RISK_SQL}, n AS (SELECT floor(count(*) * 0.3 + 0.5)::INT AS n FROM lab),
o AS (SELECT row_id, row_number() OVER (ORDER BY -ln(1.0::DOUBLE - {unit_sql(8, 'row_id')}) / risk, row_id) AS r FROM risk)
SELECT row_id, (r <= n)::INT::DOUBLE AS y FROM o, n""")
def phenotype_case_control(spark, sf):
    r = _risk(spark, sf)
    return phenotypes.case_control(r, 0.3, fx.table(spark, sf, "labels").filter("toxic IS NOT NULL").count(), 8)


SIGNAL_SQL = f"{fx.XS_SQL}, {fx.BETA_SQL}, s AS (SELECT row_id, sum(x * b) AS s FROM xs JOIN beta USING (j) GROUP BY row_id), li AS (SELECT row_id, s + sqrt((SELECT var_pop(s) * (1 - 0.5) / 0.5 FROM s)) * {normal_sql(12, 'row_id')} AS y FROM s)"


def _signal(spark, sf):
    w = spark.createDataFrame(list(fx.PLANTED), "j int, w double")
    return design.x_times(design.standardise(fx.embedding_long(spark, sf)), w).withColumnRenamed("v", "s")


@query(f"WITH {SIGNAL_SQL} SELECT row_id, {R('y')} AS y FROM li")
def phenotype_linear(spark, sf):
    return phenotypes.linear(_signal(spark, sf), 0.5, 12).select("row_id", r6("y").alias("y"))


@query(f"WITH {SIGNAL_SQL} SELECT row_id, (y >= (SELECT quantile_cont(y, 0.8) FROM li))::INT::DOUBLE AS y FROM li")
def phenotype_liability(spark, sf):
    return phenotypes.liability(_signal(spark, sf), 0.5, 0.2, 12)


# Streams


@query(f"WITH {CA_SQL} SELECT j, {R('z')} AS z FROM ca")
def ca_test_streamed(spark, sf):
    """The trend test over a stream of dosages: running sums, finished when the source is."""
    return streams.trend_over_stream(spark, *fx.text_dosages(spark, sf)).select("j", r6("z").alias("z"))


# Races; no SQL can run them


def _fit(spark, sf, **o) -> selector.Selected:
    return selector.select(spark, *fx.planted(spark, sf), selector.Options(target=0.1, seed=5, **o))


@query()
def trex_early_stop(spark, sf):
    return _fit(spark, sf, mode="calibrate_t").selected


@query()
def trex_posthoc(spark, sf):
    return _fit(spark, sf, mode="calibrate_t", posthoc=True, t_stop=10).selected


@query()
def trex_fixed(spark, sf):
    return _fit(spark, sf, mode="fixed", t_stop=3).selected


@query()
def trex_calibrate_l(spark, sf):
    return _fit(spark, sf, mode="calibrate_l", t_stop=3).run


@query()
def trex_calibrate_both(spark, sf):
    return _fit(spark, sf).run


@query()
def trex_omp(spark, sf):
    return _fit(spark, sf, mode="calibrate_t", solver="omp").selected


@query()
def trex_afs(spark, sf):
    return _fit(spark, sf, mode="calibrate_t", solver="afs", rho=0.3).selected


@query()
def trex_logistic(spark, sf):
    return _fit(spark, sf, mode="calibrate_t", solver="afs_logistic").selected


@query()
def trex_gaussian(spark, sf):
    return _fit(spark, sf, mode="calibrate_t", law="gaussian").selected


@query()
def trex_null(spark, sf):
    """A response without signal: as a rule nothing is selected."""
    x = design.standardise(fx.embedding_long(spark, sf))
    y = design.center(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("double").alias("y")), "y")
    return selector.select(spark, x, y, selector.Options(target=0.1, mode="calibrate_t", seed=5)).run


def _path(solver, rho=1.0):
    def run(spark, sf):
        return selector.path_table(spark, *fx.planted(spark, sf), solver, 5, L, rho=rho).select("step", "j", r6("beta").alias("beta"))

    return run


for _name, _solver, _rho in (("lars_path", "lars", 1.0), ("omp_path", "omp", 1.0), ("afs_path", "afs", 0.3), ("logistic_path", "afs_logistic", 1.0)):
    QUERIES[_name] = _path(_solver, _rho)


@query()
def terminating_path(spark, sf):
    """A lasso path among explicit null columns, until the third of them is active."""
    x, y, _ = selector.local_matrix(*fx.planted(spark, sf))
    d = kernels.explicit_null(len(y), P, "gaussian", 5)
    return explicit.TerminatingPath(x, d, y, lasso=True).run(3).coefficients(spark).select("step", "kind", "idx", r6("beta").alias("beta"))


@query()
def race_accessors(spark, sf):
    x, y, _ = selector.local_matrix(*fx.planted(spark, sf))
    race = kernels.make("lars", x, y, L, seed=5).run(3)
    return tables.accessor_tables(spark, race)["products"].select("kind", "idx", r6("c").alias("c"))


@query()
def race_table_function(spark, sf):
    """Entries of four races, asked for in SQL."""
    x, y, _ = selector.local_matrix(*fx.planted(spark, sf))
    tables.register_races(spark, "fdr_races", x, y, seed=5)
    return spark.sql(f"SELECT k.id AS k, r.* FROM range(4) k, LATERAL fdr_races(CAST(k.id AS INT), {L}, 3) r")


@query()
def block_lars(spark, sf):
    """The same races with the matrix left distributed."""
    x, y = fx.planted(spark, sf)
    f = design.feature_major(x).repartition(8, "j").persist()
    v = np.array([r["y"] for r in y.orderBy("row_id").collect()])
    return block.block_races(spark, f, v, P, L, 2, 4, seed=5)


@query()
def explicit_null_laws(spark, sf):
    return studies.explicit_races(spark, *fx.planted(spark, sf))


#: Knockoff+ can select k columns only at levels of 1/k and more: five planted ones need 0.2, and 0.3 leaves room for a miss.
KNOCKOFF_LEVEL = 0.3


def _rival(name):
    def run(spark, sf):
        alpha = KNOCKOFF_LEVEL if name.startswith("ko") else 0.1
        x, y = fx.planted(spark, sf)
        if name == "ko_id":  # its copies have unit variance, so the columns get it too
            x = with_scalars(x, y.agg(F.sqrt(F.count("*")).alias("_n"))).select("row_id", "j", (F.col("x") * F.col("_n")).alias("x"))
        return rivals.run(spark, x, y, name, alpha=alpha, seed=3).select("j", r6("statistic").alias("statistic"))

    return run


for _name in rivals.METHODS:
    QUERIES[f"method_{_name}"] = _rival(_name)
for _name, _dependent in (("method_bh_stream", False), ("method_by_stream", True)):
    SQL[_name] = f"SELECT j, p AS statistic FROM ({_up_sql(_dependent)}) WHERE reject"
#: A regression on all columns and a constant: the Gram matrix beside the unit matrix, eliminated column by column.
_M = P + 1
OLS_SQL = f"""WITH RECURSIVE {fx.P_SQL},
u AS (SELECT row_id, j + 1 AS i, x AS v FROM xs UNION ALL SELECT row_id, {_M}, 1.0::DOUBLE FROM y),
gr AS (SELECT a.i, b.i AS k, sum(a.v * b.v) AS s FROM u a JOIN u b USING (row_id) GROUP BY 1, 2),
m0 AS (SELECT list(list_concat(r, [CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR c IN range(1, {_M + 1})]) ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY k) AS r FROM gr GROUP BY i)),
el AS (SELECT 1 AS k, m FROM m0 UNION ALL
  SELECT k + 1, list_transform(range(1, {_M + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
    ELSE list_transform(range(1, {2 * _M + 1}), lambda c: m[i][c] - m[i][k] / m[k][k] * m[k][c]) END) FROM el WHERE k <= {_M}),
iv AS (SELECT unnest(range(1, {_M + 1})) AS i, m FROM el WHERE k = {_M + 1}),
xy AS (SELECT i, sum(v * y) AS s FROM u JOIN y USING (row_id) GROUP BY i),
co AS (SELECT iv.i, sum(m[iv.i][{_M} + xy.i] * s) AS b, any_value(m[iv.i][{_M} + iv.i]) AS d FROM iv, xy GROUP BY iv.i),
rs AS (SELECT (SELECT sum(y * y) FROM y) - (SELECT sum(b * s) FROM co JOIN xy USING (i)) AS rss, (SELECT count(*) FROM y) - {_M} AS df),
k AS (SELECT j, p, row_number() OVER (ORDER BY p, j) AS rank, count(*) OVER () AS m FROM (SELECT (i - 1)::INT AS j, {t_two_sided_sql('(b / sqrt(d * rss / df))', 'df')} AS p FROM co, rs WHERE i <= {P}))"""


def _ols_up_sql(dependent: bool) -> str:
    h = "list_sum([1.0::DOUBLE / i FOR i IN range(1, m + 1)])" if dependent else "1.0::DOUBLE"
    return f"""{OLS_SQL}, c AS (SELECT coalesce(max(rank), 0) AS kk FROM k WHERE p <= rank * 0.1::DOUBLE / (m * {h}))
SELECT j, {R('p')} AS statistic FROM k, c WHERE rank <= kk"""


SQL |= {"method_bh": _ols_up_sql(False), "method_bh_ols": _ols_up_sql(False), "method_by": _ols_up_sql(True)}
SQL["method_ko_id"] = f"""WITH {CORR_SQL}, xk AS (SELECT row_id, j, {normal_sql(3, 'row_id', 'j')} AS x FROM x),
w AS (SELECT j, abs(c * sqrt((SELECT count(*) FROM y))) - abs(ck) AS w FROM corr JOIN (SELECT j, sum(x * y) AS ck FROM xk JOIN y USING (row_id) GROUP BY j) USING (j)),
t AS (SELECT DISTINCT abs(w) AS t FROM w WHERE w <> 0),
ok AS (SELECT t FROM t, w GROUP BY t HAVING (1 + sum((w <= -t)::INT))::DOUBLE / greatest(1, sum((w >= t)::INT)) <= {KNOCKOFF_LEVEL})
SELECT j, {R('w')} AS statistic FROM w WHERE w >= coalesce((SELECT min(t) FROM ok), 'inf'::DOUBLE)"""


BINARY_SQL = f"""WITH {CA_SQL}, cp AS (SELECT j, {normal_two_sided_sql('z')} AS p FROM ca),
k AS (SELECT j, p, row_number() OVER (ORDER BY p, j) AS rank, count(*) OVER () AS m FROM cp),
c AS (SELECT coalesce(max(rank), 0) AS kk FROM k WHERE p <= rank * 0.1::DOUBLE / m) SELECT j, {R('p')} AS statistic FROM k, c WHERE rank <= kk"""


@query(BINARY_SQL)
def method_bh_binary(spark, sf):
    """A binary response with more columns than rows: trend tests."""
    g, y = fx.text_dosages(spark, sf)
    return rivals.run(spark, g.withColumnRenamed("g", "x"), y, "bh", alpha=0.1).select("j", r6("statistic").alias("statistic"))


@query(BINARY_SQL)
def method_bh_stream_binary(spark, sf):
    g, y = fx.text_dosages(spark, sf)
    return rivals.run(spark, g.withColumnRenamed("g", "x"), y, "bh_stream", alpha=0.1).select("j", r6("statistic").alias("statistic"))


@query()
def all_methods(spark, sf):
    """All methods over one matrix, without their times, which no rerun repeats."""
    x, y = fx.planted(spark, sf)
    return rivals.run_all(spark, x, y, TRUTH, list(rivals.METHODS), alpha=0.1, seed=3).drop("runtime_s")


@query()
def fdr_study(spark, sf):
    """Replicates of a random design: false discovery and true positive shares of the selection."""
    return studies.fdr_study(spark, reps=16, n=80, p=120, active=5, snr=2.0, alpha=0.2, seed=9)


@query()
def equivalence_study(spark, sf):
    """Order statistics of first correlations, virtual against explicit null columns."""
    return studies.equivalence_study(spark, reps=40, n=60, dummies=200, top=5, seed=2)


@query()
def universality_study(spark, sf):
    return studies.universality_study(spark, reps=24, n=100, dummies=150, seed=4)


@query()
def law_study(spark, sf):
    """Selection under spherical against Gaussian null columns, per target level."""
    return studies.law_study(spark, *fx.planted(spark, sf), alphas=(0.05, 0.1, 0.2, 0.3), seed=6)


def flagship(spark, sf_dir: str) -> DataFrame:
    return trex_early_stop(spark, sf_dir)


@query()
def memory_study(spark, sf):
    """Sizes of the null columns, virtual against explicit; times and peaks, which no rerun repeats, are left out."""
    return studies.memory_study(spark, sizes=(200, 400), n=100, t=5, seed=1).select("p", "kind", "pool_mb")


