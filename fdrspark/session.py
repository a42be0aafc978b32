"""Making this library importable by a session's Python workers."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or of its context.

    Where that is unset a local session gets a temporary folder of its own; any
    other must name one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = f"file://{tempfile.mkdtemp(prefix='fdrspark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def once(df):
    """df written to the shared folder and read from there, for results that are read twice: sums of doubles depend on the order in which parts arrive, so a second evaluation may differ in the last bit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark) -> None:
    """Send the library's sources to the executors, once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_fdrspark_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="fdrspark-")) / "fdrspark.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in [*sorted((ROOT / "fdrspark").rglob("*.py")), ROOT / "corpus_pipeline.py"]:
            if p.exists():
                z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(to))
    sc._fdrspark_shipped = True


def shipped(query):
    """query(spark, ...) with the library sent ahead."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
