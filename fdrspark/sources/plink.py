"""PLINK 1 binary genotypes as a Spark data source, and a writer for tests."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: magic number with the variant-major flag; the codes 0, 1, 2, 3 as copies of the first allele (1: missing).
MAGIC = b"\x6c\x1b\x01"
COPIES = (2, -1, 1, 0)


def samples(path: str) -> list[str]:
    with open(path + ".fam") as f:
        return [line.split()[1] for line in f if line.strip()]


def variants(path: str) -> list[tuple[str, str, int, str, str]]:
    """(chromosome, name, position, first allele, second allele)"""
    with open(path + ".bim") as f:
        return [(c[0], c[1], int(c[3]), c[4], c[5]) for line in f if (c := line.split())]


def decode(data: bytes, n: int) -> np.ndarray:
    """Copies of the first allele of n samples, -1 where missing."""
    b = np.frombuffer(data, np.uint8)
    codes = np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).reshape(-1)[:n]
    return np.array(COPIES, np.int8)[codes]


class _Block(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block
        self.n, self.names = len(samples(path)), variants(path)
        stride = (self.n + 3) // 4
        if os.path.getsize(path + ".bed") != 3 + stride * len(self.names):
            raise ValueError(f"{path}.bed doesn't have {len(self.names)} variants of {self.n} samples")

    def partitions(self):
        return [_Block(s, min(self.block, len(self.names) - s)) for s in range(0, len(self.names), self.block)]

    def read(self, part):
        stride = (self.n + 3) // 4
        with open(self.path + ".bed", "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path}.bed isn't a variant-major PLINK file")
            f.seek(3 + part.first * stride)
            for lo in range(0, part.count, 256):
                js = range(part.first + lo, part.first + min(lo + 256, part.count))
                g = [decode(f.read(stride), self.n).astype(float) for _ in js]
                rows = [[None if v < 0 else float(v) for v in x] for x in g]
                yield pa.RecordBatch.from_arrays([pa.array(list(js), pa.int32()), *[pa.array([self.names[j][k] for j in js], pa.int64() if k == 2 else pa.string()) for k in range(5)], pa.array(rows, pa.list_(pa.float64()))], names=["j", "chrom", "sid", "pos", "a1", "a2", "g"])


class PlinkSource(DataSource):
    """spark.read.format("plink").load(prefix): (j, chrom, sid, pos, a1, a2, g array<double>), g counting a1, null where not called."""

    @classmethod
    def name(cls) -> str:
        return "plink"

    def schema(self) -> str:
        return "j int, chrom string, sid string, pos long, a1 string, a2 string, g array<double>"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("block", 4096)))


def read_plink(spark: SparkSession, path: str, block: int = 4096) -> DataFrame:
    spark.dataSource.register(PlinkSource)
    return spark.read.format("plink").option("block", block).load(path)


def write_plink(path: str, g: np.ndarray, chrom: str = "1") -> None:
    """g (samples x variants) with copies 0, 1, 2 of the first allele, -1 missing."""
    n, p = g.shape
    code = {c: i for i, c in enumerate(COPIES)}
    with open(path + ".bed", "wb") as f:
        f.write(MAGIC)
        for j in range(p):
            b = np.zeros((n + 3) // 4 * 4, np.uint8)
            b[:n] = [code[int(v)] for v in g[:, j]]
            q = b.reshape(-1, 4)
            f.write((q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes())
    with open(path + ".fam", "w") as f:
        f.writelines(f"f{i} s{i} 0 0 0 -9\n" for i in range(n))
    with open(path + ".bim", "w") as f:
        f.writelines(f"{chrom}\trs{j}\t0\t{j + 1}\tA\tG\n" for j in range(p))
