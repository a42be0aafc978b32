"""Substring dedup, Jaccard join, Hamming search, components and the pipeline, against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fdrspark.llm import chosen_path, hamming, recompress
from fdrspark.llm.common import hot_keys, join_split
from fdrspark.llm.components import components

SF = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "doc_id long, text string")


def plain_removal(texts, window):
    ws = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def check_removal(spark, texts, window):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in recompress.remove_repeats(docs(spark, texts), window=window).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, window)


@pytest.mark.parametrize("seed", range(4))
def test_removal_equals_brute_force_on_random_texts(spark, seed):
    rng = np.random.default_rng(seed)
    alphabet = ["a", "b"] if seed == 0 else [f"w{i}" for i in range(30)]
    passage = [str(rng.choice(alphabet)) for _ in range(60)]
    texts = []
    for _ in range(40):
        w = [str(rng.choice(alphabet)) for _ in range(int(rng.integers(0, 120)))]
        if rng.random() < 0.6:
            at, lo = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 20))
            w[at:at] = passage[lo : lo + int(rng.integers(5, 60))]
        texts.append(" ".join(w))
    check_removal(spark, texts, 8 if seed == 0 else 12)


def test_removal_of_runs_periods_copies_and_odd_rows(spark):
    base = " ".join(f"u{i}" for i in range(80))
    texts = [None, "", " \t", "one", base, base, base.upper(), "x " * 36, "x " * 35, "y " * 35, "p q " * 40, "p q r " * 30, base + " tail " + base, "é ü " * 50, "head " + " ".join(f"u{i}" for i in range(20, 60))]
    check_removal(spark, texts, 35)


def test_removal_of_repeated_rows_and_ids(spark):
    base = " ".join(f"k{i}" for i in range(50))
    d = docs(spark, [base, base, "a b", base + " z", None], [7, 7, 7, None, None]).withColumn("kept", F.lit(1)).withColumn("id", F.lit("clash"))
    got = sorted((r["n_words"], r["n_removed"]) for r in recompress.remove_repeats(d).collect())
    assert got == [(0, 0), (2, 0), (50, 50), (50, 50), (51, 50)]
    assert recompress.remove_repeats(d.limit(0)).count() == 0


#: Two texts with one 32-bit Murmur hash.
COLLIDING = ("w121766 u0 u1 u2", "w126984 u0 u1 u2")


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    d = docs(spark, [*COLLIDING, COLLIDING[0]], [None, None, 5])
    got = {(r["doc_id"], r["kept"]) for r in recompress.remove_repeats(d, window=3).collect()}
    assert got == {(None, ""), (None, "w126984"), (5, "")}
    got = sorted((r["class_id"] or 0, r["n_links"], r["doc_id"] or 0) for r in chosen_path.jaccard_classes(d, n=1).collect())
    assert got == [(0, 0, 0), (5, 1, 0), (5, 1, 5)]
    kept = {(r["doc_id"], r["text"]) for r in chosen_path.keep_one(d, n=1).collect()}
    assert kept == {(5, COLLIDING[0]), (None, COLLIDING[1])}


def test_hot_keys_are_dealt_and_lose_nothing(spark):
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
    side = spark.range(0, 30_000, 2).selectExpr("id AS k2", "id AS v").unionByName(spark.createDataFrame([(7, 1)], "k2 long, v long"))
    counts = rows.groupBy("k").count()
    hot = hot_keys(counts, "k", "count")
    assert [r[0] for r in hot.collect()] == [7]
    got = join_split(rows, side, "k", "k2", hot, ["id"])
    assert got.select("id", "v").exceptAll(rows.join(side, F.col("k") == F.col("k2")).select("id", "v")).count() == 0
    assert got.count() == rows.join(side, F.col("k") == F.col("k2")).count()
    left = join_split(rows, side, "k", "k2", hot, ["id"], "left")
    assert left.count() == 30_000 and left.columns == ["id", "k", "k2", "v"]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 4, 4000).astype(np.uint64)
    starts, name, place = recompress.anchors(names, np.array([1000, 0, 20, 2980]), 20)
    by = {}
    for s, n, p in zip(starts.tolist(), name.tolist(), place.tolist(), strict=True):
        w = tuple(names[s : s + 20])
        assert by.setdefault(w, (n, p - s)) == (n, p - s)
        assert s <= p < s + 20


def test_names_are_those_of_a_global_table(spark):
    """Each name of each round stands for one thing in all documents; rounds with a table of numbers give the same equalities."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = recompress.name_table(d.repartition(5))
    assert table.count() > 1000
    assert table.groupBy("round", "name").count().filter("count > 1").count() == 0
    assert table.groupBy("round", "a", "b").count().filter("count > 1").count() == 0
    # Rounds that number things in a table, in the order in which they are met, beside those of hashes.
    texts = [r["text"] or "" for r in d.limit(60).collect()] + ["a a a b b a a a b b"] * 2
    ws = [recompress.words_of(t) for t in texts]
    sizes = np.array([len(w) for w in ws])
    numbers: dict = {}
    number = lambda x: numbers.setdefault(x, len(numbers))
    flat = [w for x in ws for w in x]
    sym, plain = recompress.WordNames().of(flat), [number(w) for w in flat]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for level, kind in enumerate(recompress.ROUNDS):
        new, _, at, bit = recompress.shortened(sym, doc, kind, level)
        stop = [*at[1:].tolist(), len(sym)]
        plain = [plain[a] if b - a == 1 else number((kind, plain[a], b - a if bit is None else plain[a + 1])) for a, b in zip(at.tolist(), stop, strict=True)]
        pairs = set(zip(new.tolist(), plain, strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        sym, doc = new, doc[at]


# Jaccard join


def plain_classes(texts, n=5, num=4, den=5):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({("short", *w)} if w else set()))
    m = len(sets)
    links, root = [0] * m, list(range(m))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(m):
        for j in range(i):
            s = len(sets[i] & sets[j])
            if sets[i] and s * den >= num * (len(sets[i]) + len(sets[j]) - s):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(find(i), links[i]) for i in range(m)]


def near_copies(rng, groups, copies, words=120, edits=6):
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(int(rng.integers(0, edits))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(1 << 30)}"
            out.append(" ".join(w))
    return out


def check_classes(spark, texts, **options):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(docs(spark, texts), **options).collect()}
    assert [got[i] for i in range(len(texts))] == plain_classes(texts)


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = near_copies(rng, 12, 6) + [None, "", "  ", "one", "one", "one two", "a b c d", "a b c d", "a b c d e", "a b c d e", "x" * 1000]
    texts += [" ".join(f"r{rng.integers(1 << 30)}" for _ in range(50)) for _ in range(30)]
    check_classes(spark, texts)


def test_classes_with_splits_and_blocks(spark):
    """Nodes and classes far above their bounds go through splits, pairs of blocks and several tasks."""
    rng = np.random.default_rng(2)
    texts = near_copies(rng, 2, 60, edits=4)
    check_classes(spark, texts, leaf=8, depth=2, block=16)


def test_a_large_group_of_near_copies_is_not_dealt_to_pairs_of_blocks(spark, monkeypatch):
    """What lies around a pivot leaves its node before that is dealt, so that rows grow with the group, not with its square."""
    texts, dealt, plain = near_copies(np.random.default_rng(5), 1, 150, edits=4), [], chosen_path._block_pairs

    def counted(rows, group, blocks):
        out = plain(rows, group, blocks)
        if group == "node":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "_block_pairs", counted)
    check_classes(spark, texts, leaf=8, depth=0)
    # A set goes to some 15 nodes.
    assert sum(dealt) <= 15 * len(texts)


def test_a_common_passage_links_nothing(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"t{rng.integers(1 << 30)}" for _ in range(100)) for _ in range(60)]
    check_classes(spark, texts, leaf=16, depth=3)


def test_one_of_each_class_stays(spark):
    rng = np.random.default_rng(4)
    texts = near_copies(rng, 5, 4) + ["solo words here in this one", None, None, ""]
    d = docs(spark, texts).withColumn("size", F.lit("clash"))
    twice = d.unionByName(d.filter("doc_id = 3"))
    kept = sorted(r["doc_id"] for r in chosen_path.keep_one(twice).collect())
    assert kept == sorted({c for c, _ in plain_classes(texts)})
    assert chosen_path.keep_one(twice).columns == d.columns
    same = docs(spark, ["q w e r t y"] * 3 + ["z"], [5, 5, None, None])
    assert sorted((r["doc_id"] or -1, r["text"][0]) for r in chosen_path.keep_one(same).collect()) == [(-1, "z"), (5, "q")]
    assert chosen_path.keep_one(same.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert chosen_path.runs_for(0.9) < chosen_path.runs_for(0.9999) < 12


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50, 60: 60}
    assert components(e.limit(0)).count() == 0


# Hamming search


def plain_nearest(codes, queries, k):
    out = {}
    for q in queries:
        d = sorted((bin((c ^ codes[q]) & (2**64 - 1)).count("1"), i) for i, c in codes.items() if c is not None)
        out[q] = [(i, dist) for dist, i in d[:k]]
    return out


@pytest.mark.parametrize("block", [10_000, 70])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.integers(-(2**63), 2**63 - 1, 6)
    codes = {}
    for i in range(400):
        c = int(centres[i % 6])
        for b in rng.integers(0, 64, int(rng.integers(0, 12))):
            c ^= 1 << int(b)
        codes[i] = (c & (2**64 - 1)) - (2**64 if c & (1 << 63) and c >= 0 else 0)
        codes[i] = int(np.uint64(codes[i] & (2**64 - 1)).astype(np.int64))
    for i in range(300, 400):
        codes[i] = codes[300]  # a large group of equal codes
    d = spark.createDataFrame([(i, c) for i, c in codes.items()] + [(None, 5), (999, None)], "id long, code long")
    got = defaultdict(list)
    for r in hamming.nearest(d, d.filter("id % 20 = 0"), 7, block=block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["distance"]))
    assert got == plain_nearest(codes, [i for i in codes if i % 20 == 0], 7)


def test_nearest_of_few_and_none(spark):
    d = spark.createDataFrame([(1, 0), (2, -1)], "id long, code long")
    assert hamming.nearest(d, d, 5).count() == 4
    assert hamming.nearest(d.limit(0), d, 5).count() == 0 and hamming.nearest(d, d.limit(0), 5).count() == 0


def test_sign_codes(spark):
    v = [1.0] + [-1.0] * 62 + [2.0]
    d = spark.createDataFrame([(v,), (None,), ([float("nan"), 3.0],), ([],)], "v array<double>")
    assert [r[0] for r in d.select(hamming.sign_code(F.col("v"))).collect()] == [1 - 2**63, None, 2, 0]


def test_queries_equal_their_sql(spark):
    import duckdb

    from fdrspark.llm import queries as Q

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    for name, sql in Q.SQL.items():
        assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(sql).df()), name


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    from fdrspark.llm.mixing import mix_plan

    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    extra = [(10_001, "!!! 123", "en", "src0", 7), (10_002, None, None, None, None), (10_003, rows[0]["text"], "en", "src1", 1), (10_004, "my password = hunter2000 is here, with more words", "en", "src1", 40), (10_005, "word here", None, None, 9)]
    spark.createDataFrame([tuple(r) for r in rows] + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, f in P.STAGES:
        f(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = d
        if name != "byte_bpe":
            assert d.columns == P.COLUMNS
    ids = lambda n: {r["doc_id"] for r in seen[n].collect()}
    every = {r["doc_id"] for r in rows} | {e[0] for e in extra}
    assert ids("language_id") == every - {10_001, 10_002}
    texts = {r["doc_id"]: r["text"] for r in seen["language_id"].collect()}
    order = sorted(texts)
    want = {order[c] for c, _ in plain_classes([texts[i] for i in order])}
    assert ids("near_duplicates") == ids("secrets") == want
    said = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert said[10_004]["text"] == "my [secret] is here, with more words" and said[10_004]["n_chars"] == 36
    plan = {r["doc_id"]: r["copies"] for r in mix_plan(seen["secrets"]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in seen["mixing"].collect()) == plan
    assert Counter(r["doc_id"] for r in seen["byte_bpe"].collect()) == plan
    import public_tokenizers
    import tiktoken

    from fdrspark.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.DEFAULT_RANKS), special_tokens={})
    want = Counter((r["doc_id"], *enc.encode_ordinary(r["text"])) for r in seen["mixing"].collect())
    assert Counter((r["doc_id"], *r["ids"]) for r in seen["byte_bpe"].collect()) == want
    assert P.run(spark, str(tmp_path)).count() == sum(plan.values())


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, extra columns with clashing names; an empty table."""
    import corpus_pipeline as P

    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (None, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "some words here, token=abcdefgh", None, None, 31), (3, "some words here, token=abcdefgh", None, None, 31), (None, "no id but text", "en", "b", 14), (None, "no id, other text", "en", "b", 17), (4, long, "en", "a", len(long)), (5, "!!! 123", "en", "a", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("carried", "id", "h", "label", "copies", "spans", "ids", "rate", "_salt"):
        d = d.withColumn(name, F.lit("clash"))
    for at, part in (("odd", d), ("none", d.limit(0))):
        part.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{at}/documents.parquet")
        sizes = []
        for name, stage in P.STAGES:
            stage(spark, docs, f"{tmp_path}/{at}").write.parquet(f"{tmp_path}/{at}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{at}/{name}")
            sizes.append(docs.count())
            if name == "secrets":
                texts = sorted(r["text"][:20] for r in docs.collect())
        if at == "none":
            assert sizes == [0] * 5
        else:
            assert sizes[:3] == [5, 4, 4] and texts == ["no id but text", "no id, other text", "some words here, [se", "word0 word1 word2 wo"]
            assert docs.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
