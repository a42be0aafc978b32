"""Queries against their SQL on the smallest tables, and the rest without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_core_queries_equal_their_sql(spark):
    import duckdb

    from fdrspark import queries as Q

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    for name in ("standardize", "argmax_corr", "bh", "phi_prime", "fdp_hat", "select_tv", "ld_components", "stratified_split", "vd_pool_extend", "method_summary"):
        assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(Q.SQL[name]).df()), name


def test_flagship_finds_something(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("gone", ["fdrspark.llm corpus_pipeline", "public_tokenizers", "zstandard"])
def test_entry_without_llm(tmp_path, gone):
    code = f"""
import sys, importlib.abc
sys.path.insert(0, {str(ROOT)!r})
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith(tuple({gone.split()!r})):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as E
q = E.queries()
assert "bh" in q and not any(n.startswith("op") for n in q) and "pipeline" not in q
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


@pytest.mark.parametrize("bad", ["fdrspark.llm"])
def test_nothing_else_imports_llm(bad):
    for p in (ROOT / "fdrspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert bad not in p.read_text(), p
