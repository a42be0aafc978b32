"""Exact top-k search over binary codes by multi-index hashing."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.llm.common import stored, table

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Rows of the index that one table of segments holds, and query codes that travel in one row.
BLOCK, PACK = 50_000, 512
K = 10


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where element i is above 0 (null, NaN and missing elements are not); null vectors have no code."""
    set_bits = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@lru_cache(maxsize=None)
def flips(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], np.int64)


class SegmentTables:
    """The codes of a block, listed by the value of each of their segments."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.codes, self.ids = codes, ids
        self.lists = []
        for j in range(SEGMENTS):
            value = ((codes >> np.uint64(j * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.lists.append((order, np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << WIDTH))])))

    def top(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest codes, ties by id.

        Segment radii grow one segment at a time. When segments 0..j were probed
        at radius s and the others at s - 1, every code within SEGMENTS * s + j
        was met, for one farther off in all segments has a larger distance. So
        the search ends once the k-th verified distance is no more than that.
        """
        q = np.uint64(query)
        met = np.zeros(len(self.codes), bool)
        found = np.zeros(0, np.int64)
        distance = np.zeros(0, np.int64)
        for s in range(WIDTH + 1):
            for j in range(SEGMENTS):
                order, first = self.lists[j]
                probes = flips(s) ^ int((query >> (j * WIDTH)) & ((1 << WIDTH) - 1))
                a, n = first[probes], first[probes + 1] - first[probes]
                total = int(n.sum())
                if total:
                    stop = np.cumsum(n)
                    rows = order[np.arange(total) - np.repeat(stop - n, n) + np.repeat(a, n)]
                    rows = rows[~met[rows]]
                    met[rows] = True
                    found = np.concatenate([found, rows])
                    distance = np.concatenate([distance, np.bitwise_count(self.codes[rows] ^ q).astype(np.int64)])
                if len(found) == len(self.codes):
                    break
                if len(found) >= k and np.partition(distance, k - 1)[k - 1] <= SEGMENTS * s + j:
                    break
            else:
                continue
            break
        best = np.lexsort((self.ids[found], distance))[:k]
        return self.ids[found][best], distance[best]


def nearest(index: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "id", code_col: str = "code", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, distance): the k rows of the index nearest to each query by Hamming distance, ties by id.

    index and queries have an id and a 64-bit code; rows without either are left
    out. All rows of the index take part, the query's own among them. Of equal
    codes only the k least ids can be in a result, so no more of them go on, and
    equal query codes are searched once. The index is dealt into blocks of about
    ``block`` rows with segment tables of their own; packs of query codes visit
    every block, and a query's results of all blocks are merged. An index of
    fewer than k rows gives fewer; an empty one none. Repeated ids are rows of
    their own.
    """
    rows = index.select(F.col(code_col).alias("code"), F.col(id_col).cast("long").alias("id")).filter("code IS NOT NULL AND id IS NOT NULL")
    asked = queries.select(F.col(code_col).alias("code"), F.col(id_col).cast("long").alias("query_id")).filter("code IS NOT NULL AND query_id IS NOT NULL")
    same = Window.partitionBy("code").orderBy("id")
    rows = stored(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k).drop("n"), "index")
    codes = stored(asked.select("code").distinct(), "query_codes")
    blocks = max(1, -(-rows.count() // block))
    packs = max(1, -(-codes.count() // PACK))
    kind = "block int, kind int, id long, code long, pack array<bigint>"
    entries = rows.select(F.pmod(F.xxhash64("id", "code"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "code", F.lit(None).cast("array<bigint>").alias("pack"))
    packed = codes.groupBy(F.pmod(F.xxhash64("code"), F.lit(packs)).alias("p")).agg(F.collect_list("code").alias("pack"))
    visits = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("code"), "pack")

    def run(batches):
        at, kept, tables = None, [], None
        for batch in batches:
            b, t, i, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            cuts = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (t[1:] != t[:-1])) + 1), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if b[lo] != at:
                    at, kept, tables = b[lo], [], None
                if t[lo] == 0:
                    kept.append((c[lo:hi].astype(np.int64).view(np.uint64), i[lo:hi].astype(np.int64)))
                    continue
                if not kept:
                    continue
                if tables is None:
                    tables = SegmentTables(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                for pack in batch.column(4).slice(lo, hi - lo).to_pylist():
                    out = [(q, *tables.top(q & 0xFFFFFFFFFFFFFFFF, k)) for q in pack]
                    n = [len(x[1]) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in out], np.int64), n)), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]).astype(np.int32))], names=["code", "id", "distance"])

    both = entries.unionByName(visits).select(*[f.split()[0] for f in kind.split(", ")])
    both = both.repartition(blocks, "block").sortWithinPartitions("block", "kind")
    found = both.mapInArrow(run, "code long, id long, distance int")
    rank = Window.partitionBy("code").orderBy("distance", "id")
    best = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return asked.join(best, "code").select("query_id", "rank", "id", "distance")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    found = nearest(codes, codes.filter(F.col("vec_id") % 100 == 0), id_col="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP5_SQL = f"""
WITH bits AS (
  SELECT vec_id, unnest(range({BITS})) AS i, unnest([coalesce(embedding[j + 1] > 0 AND NOT isnan(embedding[j + 1]), false) FOR j IN range({BITS})]) AS b
  FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id, sum((q.b <> e.b)::INT)::INT AS distance
  FROM bits q JOIN bits e ON q.i = e.i WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {K}
"""
