import json
import time
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fdrspark.operators import design, marginal, prune, summaries
from fdrspark.operators import votes as V
from fdrspark.plans import block, kernels, selector, studies
from fdrspark.sources import matrix_files, plink, results

SF = "/root/testdata/sf0.001"


def long(spark, x):
    n, p = x.shape
    return spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(p)], "row_id long, j int, x double")


def response(spark, y):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_id long, y double")


def test_standardise_handles_constant_columns(spark):
    x = np.column_stack([np.arange(5.0), np.ones(5)])
    d = design.standardise(long(spark, x)).toPandas().pivot(index="row_id", columns="j", values="x")
    assert abs(np.linalg.norm(d[0]) - 1) < 1e-12 and (d[1] == 0).all()


def test_step_up_matches_the_definition(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(80), rng.random(20) * 0.002])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "j int, p double")
    for dependent in (False, True):
        h = sum(1 / i for i in range(1, 101)) if dependent else 1
        s = np.sort(p)
        k = max([0, *(i + 1 for i in range(100) if s[i] <= (i + 1) * 0.1 / (100 * h))])
        got = marginal.step_up(d, 0.1, dependent).filter("reject").count()
        assert got == k
    assert marginal.step_up(d.limit(0), 0.1).count() == 0


def test_knockoff_threshold(spark):
    w = [3.0, -1.0, 2.0, 5.0, 4.0, 0.0, -0.5]
    d = spark.createDataFrame(list(enumerate(w)), "j int, w double")
    ok = [t for t in sorted({abs(v) for v in w} - {0}) if (1 + sum(v <= -t for v in w)) / max(1, sum(v >= t for v in w)) <= 0.5]
    assert marginal.knockoff_threshold(d, 0.5).first()[0] == (min(ok) if ok else float("inf"))
    assert marginal.knockoff_threshold(d, 0.01).first()[0] == float("inf")


def test_statistics_and_threshold_come_from_one_evaluation(spark):
    """Statistics that are a little less whenever they are evaluated anew: the threshold's own column still stays."""
    later = F.udf(lambda j: 10.0 + j - time.time() * 1e-9, "double").asNondeterministic()
    d = spark.range(20).select(F.col("id").cast("int").alias("j"), later("id").alias("w"))
    assert marginal.knockoff_select(d, 0.5).filter("selected").count() == 20


def test_global_rank_is_a_permutation(spark):
    d = spark.range(1000).select("id", (F.col("id") * 7919 % 1009).alias("x"))
    r = marginal.global_rank(d, ["x", "id"]).toPandas().sort_values(["x", "id"])
    assert list(r["rank"]) == list(range(1, 1001))


def test_common_samples(spark):
    d = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "c", 0), (2, "a", 1)], "chrom int, iid string, pos int")
    got = {(r["chrom"], r["iid"]): (r["pos"], r["rank"]) for r in design.common_samples(d).collect()}
    assert got == {(1, "a"): (0, 1), (1, "c"): (2, 2), (2, "a"): (1, 1), (2, "c"): (0, 2)}


def test_clusters_of_a_chain_and_modes(spark):
    cols = spark.range(7).select(F.col("id").cast("int").alias("j"))
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "j1 int, j2 int")
    lab = prune.clusters(cols, pairs)
    assert {r["j"]: r["cluster"] for r in lab.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}
    assert {r["cluster"]: r["j"] for r in prune.representatives(lab).collect()} == {0: 0, 4: 4, 5: 5}
    with pytest.raises(ValueError):
        prune.representatives(lab, "other")


def test_edges_by_rows_and_by_blocks_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 10))
    x[:, 7] = x[:, 2] + 0.1 * rng.standard_normal(80)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    by_rows = {(r["j1"], r["j2"]) for r in prune.edges(rows, 10, 0.5).collect()}
    f = design.feature_major(design.standardise(long(spark, x)))
    assert by_rows == {(r["j1"], r["j2"]) for r in prune.block_edges(f, 0.5, block=4).collect()} == {(2, 7)}


def test_surface_and_selection_equal_the_local_twin(spark):
    x, y, _ = studies.problem(5, 0, 80, 40, 4, 3.0)
    o = selector.Options(target=0.2, experiments=10, l_factor=5, mode="calibrate_t", posthoc=True, t_stop=5, seed=9)
    s = selector.select(spark, long(spark, x), response(spark, y), o)
    want = studies.local_selection(x, y, 0.2, 10, 200, 5, 9)
    assert sorted(r["j"] for r in s.selected.collect()) == sorted(want.tolist())
    assert s.surface.count() == 5 * len(V.voting_grid(spark, 10).collect())


def test_early_stop_agrees_with_a_loop(spark):
    x, y, _ = studies.problem(6, 0, 80, 40, 4, 3.0)
    o = selector.Options(target=0.2, experiments=10, l_factor=5, mode="calibrate_t", stride=2, max_stale=2, t_stop=12, seed=1)
    s = selector.select(spark, long(spark, x), response(spark, y), o)
    full = selector.select(spark, long(spark, x), response(spark, y), replace(o, posthoc=True))
    top = {r["t"]: r["fdp_hat"] for r in full.surface.filter("v_idx = 5").collect()}
    above = {r["t"]: r["n"] for r in full.votes.filter("phi > 0.5").groupBy("t").agg(F.count("*").alias("n")).collect()}
    prev = stale = 0
    for t in range(2, 13, 2):
        if top[t] > 0.2:
            break
        n = above.get(t, 0)
        stale = stale + 1 if n <= prev else 0
        prev = n
        if stale >= 2:
            break
    assert s.t_explored == t


def test_no_signal_and_one_experiment(spark):
    rng = np.random.default_rng(3)
    x, _, _ = studies.problem(7, 0, 60, 30, 0, 1.0)
    y = rng.standard_normal(60)
    s = selector.select(spark, long(spark, x), response(spark, y - y.mean()), selector.Options(target=0.05, experiments=1, l_factor=1, mode="fixed", t_stop=1))
    assert s.run.first()["p"] == 30
    with pytest.raises(ValueError):
        selector.Options(mode="other")


def test_block_races_equal_local_ones(spark):
    x, y, _ = studies.problem(8, 0, 60, 50, 3, 3.0)
    f = design.feature_major(long(spark, x)).repartition(3, "j")
    got = sorted((r["k"], r["pos"], r["kind"], r["idx"]) for r in block.block_races(spark, f, y, 50, 100, 2, 2, seed=4).collect())
    want = [(k, i + 1, e[0], e[1]) for k in range(2) for i, e in enumerate(kernels.make("lars", x, y, 100, seed=4, experiment=k).run(2).entries)]
    assert got == want


def test_matrix_files(spark, tmp_path):
    a = np.arange(60.0).reshape(6, 10)
    f = matrix_files.write_matrix(str(tmp_path / "X_raw.dat"), a)
    assert f.shape == (6, 10) and f.nbytes == 480 and np.array_equal(f.as_array(), a)
    d = matrix_files.read_matrix(spark, f.path, 6, 10, columns=[1, 8], block=4).orderBy("j").collect()
    assert [(r["j"], r["x"]) for r in d] == [(1, a[:, 1].tolist()), (8, a[:, 8].tolist())]
    assert matrix_files.load(spark, str(tmp_path), 6, 10)[1] == "raw"
    with pytest.raises(ValueError):
        matrix_files.MatrixFile(f.path, 6, 11)
    g, at = matrix_files.write_blocks([a, a[:, :3]], str(tmp_path / "both.dat"))
    assert g.shape == (6, 13) and at == [0, 10]


def test_plink_round_trip(spark, tmp_path):
    g = np.random.default_rng(4).integers(-1, 3, (7, 5))
    plink.write_plink(str(tmp_path / "chr1"), g)
    d = plink.read_plink(spark, str(tmp_path / "chr1"), block=2).orderBy("j").collect()
    assert [[-1 if v is None else int(v) for v in r["g"]] for r in d] == g.T.tolist()
    assert d[3]["sid"] == "rs3"


def test_results(spark, tmp_path):
    for run, method in ((0, "bh"), (1, "trex")):
        Path(tmp_path / f"run_{run}_{method}.json").write_text(json.dumps({"fdp": 0.1 * run, "tpp": 1.0}))
    Path(tmp_path / "run_2_by.json").write_text("{broken")
    d = results.read_results(spark, f"{tmp_path}/*.json").collect()
    assert {(r["run"], r["method"]) for r in d if r["tpp"] is not None} == {(0, "bh"), (1, "trex")}
    results.write_once(spark.range(2), f"{tmp_path}/once")
    results.write_once(spark.range(5), f"{tmp_path}/once")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2
    results.write_meta(spark, f"{tmp_path}/m", {"run_id": 1, "seed": 2, "per_chromosome": [(1, 10, 5, 4)]}, ["a", "b"])
    assert spark.read.json(f"{tmp_path}/m/meta").first()["per_chromosome"][0]["p_pruned"] == 5


def test_distances(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.random.default_rng(5).standard_normal(500))], "id long, x double")
    assert summaries.ks_normal(d).first()["ks"] < 0.08
    assert summaries.w1_normal(d).first()["w1"] < 0.15
    assert summaries.ks_normal(d.limit(10)).first()["ks"] is None


def _planted(n=120, p=30, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p))
    x -= x.mean(0)
    x /= np.linalg.norm(x, axis=0)
    y = x[:, :4] @ np.array([5.0, -5, 4, 4]) + rng.standard_normal(n) * 0.3
    return x, y - y.mean()


def test_selection_is_the_same_with_the_matrix_distributed(spark, monkeypatch):
    x, y = _planted()
    for o in (selector.Options(target=0.2, experiments=6, l_factor=3, mode="calibrate_t", stride=2, max_stale=2, t_stop=8, seed=2), selector.Options(target=0.2, experiments=6, seed=2, t_stop=3)):
        got = []
        for most in (1 << 30, 0):
            monkeypatch.setattr(selector, "LOCAL_BYTES", most)
            s = selector.select(spark, long(spark, x), response(spark, y), o)
            got.append((s.t_explored, s.n_dummies, sorted((r["j"], round(r["phi"], 9)) for r in s.selected.collect())))
        assert got[0] == got[1] and {0, 1, 2, 3} <= {j for j, _ in got[0][2]}
    with pytest.raises(ValueError, match="omp"):
        selector.select(spark, long(spark, x), response(spark, y), replace(o, solver="omp"))
    f = design.feature_major(long(spark, x))
    with pytest.raises(RuntimeError, match="max_rounds"):
        block.block_races(spark, f, y, 30, 60, 5, 2, max_rounds=2)


def test_races_go_on_from_their_states(spark):
    x, y = _planted()
    for solver in ("lars", "omp", "afs", "afs_logistic"):
        o = selector.Options(experiments=3, solver=solver, seed=4, rho=0.5)
        at_once = selector.races(spark, x, y, 60, 5, o)
        first = selector.races(spark, x, y, 60, 2, o)
        then = selector.races(spark, x, y, 60, 5, o, saved=first)
        rows = lambda d: sorted(map(tuple, selector.entries_of(d).drop("status").collect()))
        assert rows(then) == rows(at_once) and len(rows(first)) < len(rows(then))


def test_t_tail_and_normal_quantile(spark):
    from statistics import NormalDist

    from fdrspark.functions import tails

    rows = [(float(t), df) for t in (0.0, 0.3, 1.0, 1.96, 3.0, 6.0) for df in (5, 10, 98, 1000)]
    got = spark.createDataFrame(rows, "t double, df int").select("t", "df", tails.t_two_sided_column(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r["p"] - tails.t_two_sided(r["t"], r["df"])[0]) < 3e-5 if r["df"] == 5 else abs(r["p"] - tails.t_two_sided(r["t"], r["df"])[0]) < 1e-6 for r in got)
    ps = [1e-6, 0.001, 0.02, 0.024, 0.3, 0.5, 0.9, 0.98, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", tails.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-7 for r in got)


def test_column_p_values_by_their_kind(spark):
    """A full regression for many rows, trend tests for a binary response, t tests else; streams give the same sums."""
    from fdrspark.plans import rivals

    x, y = _planted(n=100, p=20)
    got = {r["j"]: r["p"] for r in rivals.p_values(spark, long(spark, x), response(spark, y)).collect()}
    assert np.allclose([got[j] for j in range(20)], rivals.ols_p(x, y, True), atol=1e-9)
    wide = long(spark, x[:30])
    stats = marginal.with_p(marginal.marginal_regression(wide, response(spark, y[:30])), "t", "df")
    want = {r["j"]: round(r["p"], 9) for r in stats.collect()}
    for streamed in (False, True):
        assert {r["j"]: round(r["p"], 9) for r in rivals.p_values(spark, wide, response(spark, y[:30]), streamed).collect()} == want
    cases = response(spark, (y[:30] > 0).astype(float))
    z = {r["j"]: round(r["p"], 9) for r in marginal.with_p(marginal.trend_test(wide.withColumnRenamed("x", "g"), cases), "z").collect()}
    for streamed in (False, True):
        assert {r["j"]: round(r["p"], 9) for r in rivals.p_values(spark, wide, cases, streamed).collect()} == z


def test_knockoffs_select_the_planted_columns(spark):
    from fdrspark.plans import rivals

    x, y = _planted(n=300, p=30)
    for name in ("ko_gaussian", "ko_hd", "bh_hd", "by_hd"):
        got = {r["j"] for r in rivals.run(spark, long(spark, x), response(spark, y), name, alpha=0.3, seed=1).collect()}
        assert {0, 1, 2, 3} <= got and len(got) <= 12, name
    got = {r["j"] for r in rivals.run(spark, long(spark, x * np.sqrt(300)), response(spark, y), "ko_id", alpha=0.3, seed=1).collect()}
    assert {0, 1, 2, 3} <= got


def test_accessors_and_the_table_function(spark):
    from fdrspark.plans import tables

    x, y = _planted()
    race = kernels.make("lars", x, y, 60, seed=5).run(3)
    t = tables.accessor_tables(spark, race)
    assert t["summary"].first()["num_realized"] == 3 and t["products"].count() == 90 and t["entries"].count() == len(race.entries)
    tables.register_races(spark, "races_here", x, y, seed=5)
    got = [(r["kind"], r["idx"], r["t0"]) for r in spark.sql("SELECT * FROM races_here(0, 60, 3) ORDER BY pos").collect()]
    assert got == race.entries


def test_sources_of_responses_and_parts_of_matrices(spark, tmp_path):
    from fdrspark.sources import responses

    a = np.arange(12.0).reshape(4, 3) ** 2
    matrix_files.write_matrix(str(tmp_path / "X_raw.dat"), a)
    d, mode = matrix_files.load(spark, str(tmp_path), 4, 3, standardise=True)
    got = np.array([r["x"] for r in d.orderBy("j").collect()]).T
    c = a - a.mean(0)
    assert mode == "raw" and np.allclose(got, c / np.linalg.norm(c, axis=0))
    raw = matrix_files.load(spark, str(tmp_path), 4, 3)[0]
    got = {r["j"]: r["x"] for r in matrix_files.gather(raw, [3, 0], [2]).collect()}
    assert got == {2: [a[3, 2], a[0, 2]]}
    np.savez(tmp_path / "pheno_run_5.npz", y=np.arange(4.0), causal_idx=np.array([1]), X_raw=a)
    y, truth, own = responses.load_response(spark, str(tmp_path), 5)
    assert y.count() == 4 and truth.first()["j"] == 1 and own.count() == 3
    assert responses.write_response(spark, str(tmp_path), 2, y, truth) and not responses.write_response(spark, str(tmp_path), 2, y, truth)
    y, truth, own = responses.load_response(spark, str(tmp_path), 2)
    assert y.count() == 4 and truth.count() == 1 and own is None
    with pytest.raises(FileNotFoundError):
        responses.load_response(spark, str(tmp_path / "none"), 1)
    assert [design.how_many(s, 10) for s in (3, "3", "0.5", "1e-1", "0.01", "99")] == [3, 3, 5, 1, 1, 10]


def test_unreadable_results_are_named(spark, tmp_path):
    (tmp_path / "run_1_bh.json").write_text('{"fdp": 0.5}')
    (tmp_path / "run_2_bh.json").write_text('{"fdp": ')
    with pytest.warns(UserWarning, match="run_2_bh"):
        assert results.read_results(spark, f"{tmp_path}/*.json").count() == 1
