"""Randomness from counters: a value depends on its key alone, never on partitions or order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(*key: Column | str | int) -> Column:
    """In [0, 1), from the MD5 of the key's parts joined by colons."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def unit_sql(*key: str | int) -> str:
    """The same in SQL; strings are SQL expressions."""
    text = " || ':' || ".join(f"'{k}'" if isinstance(k, int) else f"({k})::VARCHAR" for k in key)
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal(*key) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2.0 * F.log(1.0 - unit(*key, 1))) * F.cos(2.0 * math.pi * unit(*key, 2))


def normal_sql(*key) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {unit_sql(*key, 1)})) * cos({2 * math.pi!r}::DOUBLE * {unit_sql(*key, 2)}))"


def sphere(nu: Column | float, *key) -> Column:
    """One coordinate of a uniform point on the unit sphere in nu + 1 dimensions.

    A Student t variable with nu degrees of freedom by the polar method, then
    t / sqrt(nu + t^2), whose square is Beta(1/2, nu/2).
    """
    nu = nu if isinstance(nu, Column) else F.lit(float(nu))
    tt = F.sqrt(F.pow(1.0 - unit(*key, 1), -2.0 / nu) - 1.0) * F.cos(2.0 * math.pi * unit(*key, 2))
    return tt / F.sqrt(1.0 + tt * tt)


def sphere_sql(nu: str, *key) -> str:
    tt = f"(sqrt(pow(1.0::DOUBLE - {unit_sql(*key, 1)}, -2.0::DOUBLE / ({nu})) - 1.0::DOUBLE) * cos({2 * math.pi!r}::DOUBLE * {unit_sql(*key, 2)}))"
    return f"({tt} / sqrt(1.0::DOUBLE + {tt} * {tt}))"


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def units(key: tuple[int, ...], counters: np.ndarray) -> np.ndarray:
    """In (0, 1): for array kernels, a value for each counter under a key."""
    state = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in key:
            state = _scramble(np.array([state + np.uint64(k & 0xFFFFFFFFFFFFFFFF) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)], np.uint64))[0]
        z = _scramble(_scramble(np.asarray(counters).astype(np.uint64) + state) + state)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def normals(key: tuple[int, ...], counters: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(units((*key, 1), counters))) * np.cos(2 * np.pi * units((*key, 2), counters))


def sphere_coordinates(nu: float, key: tuple[int, ...], counters: np.ndarray) -> np.ndarray:
    tt = np.sqrt(units((*key, 1), counters) ** (-2.0 / nu) - 1) * np.cos(2 * np.pi * units((*key, 2), counters))
    return tt / np.sqrt(1 + tt * tt)
