"""Helpers shared by the text operators: words, 64-bit names, shared tables."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fdrspark.session import shared_dir

#: Most bytes of words, with an entry's overhead each, whose names one worker keeps; beyond it the memo starts anew.
MEMO_BYTES, ENTRY_BYTES = 24 << 20, 150
#: Most bytes of an Arrow batch on its way to or from a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Keys with more than 1/HOT of all rows are hot: there are fewer than HOT of them. Their rows are dealt over SALTS tasks.
HOT, SALTS = 1000, 64
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; null has none.

    ``bytes.split`` divides at space, tab, LF, VT, FF and CR, which are those
    code points and no others.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class WordNames(dict):
    """word -> 64-bit name (BLAKE2b), kept for words seen by this worker, within MEMO_BYTES."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        name = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.held += len(word) + ENTRY_BYTES
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def trimmed(run):
    """A map over batches that gives unused memory back to the system when its task ends, for workers outlive tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective finaliser (SplitMix64) of x + salt; x is left as it is."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def pair_name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The name of a followed by b; not symmetric, not linear."""
    with np.errstate(over="ignore"):
        return mix((a * np.uint64(0x9FB21C651E98DF25)) ^ mix(b, salt), salt + 1)


def texts(batch: pa.RecordBatch, i: int) -> list[str]:
    """Column i as Python strings, null as ''."""
    return [x or "" for x in batch.column(i).to_pylist()]


def slices(batch: pa.RecordBatch, i: int, most: int = 2 << 20):
    """batch in slices whose texts in column i have about ``most`` bytes together; a longer text is a slice of its own."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // most)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


#: The tables that this process has written, in their order.
_made: list[str] = []


def tables_made() -> int:
    return len(_made)


def release(spark: SparkSession, first: int, last: int) -> None:
    """Delete the tables made as numbers first to last (not included): those that nothing reads any more."""
    for k in range(first, last):
        if _made[k]:
            _forget(spark, _made[k])
            _made[k] = ""


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()  # a folder of its own
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written to a table in the shared folder, and read from there: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fdrspark-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _made.append(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; batches to Python are bounded by bytes from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns' text alone; the same in any engine with MD5."""
    text = F.concat_ws(":", *[(c if isinstance(c, Column) else F.col(c)).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def fold_of(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text, modulo 3; rows with 1 are held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 3


def text_digest(text: Column | str) -> Column:
    """128 bits (MD5) that stand for a text; null has no bits, but a value."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.unhex(F.md5(c.cast("binary"))), F.lit(b""))


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """(_hot): keys that hold more than 1/HOT of all rows, from (key, rows); fewer than HOT, whatever the input is. None if no key does."""
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    least = max(1000, (total or 0) // HOT)
    return counts.filter(F.col(n) > least).select(F.col(key).alias("_hot")) if (most or 0) > least else None


def join_split(rows: DataFrame, side: DataFrame, key: str, side_key: str, hot: DataFrame | None, spread: list[str], how: str = "inner", on=None) -> DataFrame:
    """rows joined to side, rows of hot keys dealt over SALTS tasks by a hash of ``spread``, side's rows of these keys sent to each.

    hot has fewer than HOT keys, which bounds what is broadcast; all other keys
    have at most 1/HOT of the rows each. ``on`` is a further condition.
    """
    if hot is None:
        same = rows[key] == side[side_key]
        return rows.join(side, same if on is None else same & on(rows, side), how)
    h = F.broadcast(hot)
    dealt = rows.join(h, rows[key] == h["_hot"], "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(SALTS))).cast("int")).drop("_hot")
    salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    sent = side.join(F.broadcast(hot), side[side_key] == F.col("_hot"), "left").withColumn("_salt2", F.explode(salts)).drop("_hot")
    same = (dealt[key] == sent[side_key]) & (dealt["_salt"] == sent["_salt2"])
    return dealt.join(sent, same if on is None else same & on(dealt, sent), how).drop("_salt", "_salt2")


def left_join_present(rows: DataFrame, side: DataFrame, key: str, side_key: str, hot: DataFrame | None, spread: list[str]) -> DataFrame:
    """rows left joined to side by ``join_split``; rows without a key, which a shuffle would bring together, stay out of it.

    rows is read twice, so it should be a stored table.
    """
    alone = rows.filter(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema])
    return join_split(rows.filter(F.col(key).isNotNull()), side, key, side_key, hot, spread, "left").unionByName(alone)


def with_carried(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None) -> tuple[DataFrame, list[str], str]:
    """docs as (id, text, other columns to go along), these columns' names, and their part of a schema as the struct ``carried``.

    Id and text go to the worker once; ``carried_of`` puts them into the struct.
    """
    more = [c for c in carry or () if c not in (id_col, text_col)]
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(more)])
    if not carry:
        return d, [], ""
    return d, more, f", carried {docs.select(F.struct(*carry).alias('c')).schema['c'].dataType.simpleString()}"


def carried_of(part: pa.RecordBatch, id_col: str, text_col: str, carry: list[str], more: list[str]) -> pa.Array:
    place = {id_col: 0, text_col: 1} | {c: 2 + k for k, c in enumerate(more)}
    return pa.StructArray.from_arrays([part.column(place[c]) for c in carry], names=list(carry))
