"""Bit tables of bounded size over 64-bit keys: a filter in front of exact joins.

A table only saves work: what passes is joined exactly afterwards, so a full
table costs time and never changes a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Table

BITS = 1 << 25


def build(keys: DataFrame, col: str, bits: int = BITS) -> Table:
    """One row: the bits of all keys as an array of longs (bits / 8 bytes). ``bits`` is a power of two."""
    spark = keys.sparkSession
    p = F.col(col).bitwiseAND(F.lit(bits - 1))
    set_ = keys.select(F.call_function("shiftright", p, F.lit(6)).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    zero = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = set_.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    return Table(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words")), "bits")


def has(words: Column, key: Column, bits: int = BITS) -> Column:
    p = key.bitwiseAND(F.lit(bits - 1))
    word = F.element_at(words, (F.call_function("shiftright", p, F.lit(6)) + 1).cast("int"))
    return F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def local(keys: DataFrame, col: str, bits: int = BITS) -> np.ndarray:
    """The bits as a numpy array of bytes, for Python workers."""
    p = F.col(col).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.call_function("shiftright", p, F.lit(6)).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def test(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = keys & np.uint64(len(table) * 8 - 1)
    return (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
