"""Filters of bounded size: a bitmap of 64-bit hashes, built by Spark and broadcast.

A bitmap says for certain that a hash is absent. It has at most ``1 << MAX_BITS`` bits (32 MB), however
many hashes there are; the more there are the less it filters, and what passes is always joined
exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

MAX_BITS = 28
MIN_BITS = 18


class Bitmap:
    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        x = hashes.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.data[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def build(hashes: DataFrame, col: str, count: int) -> Bitmap:
    """The bitmap of a column of 64-bit hashes; ``count``: about how many there are."""
    bits = min(MAX_BITS, max(MIN_BITS, (16 * max(1, count)).bit_length()))
    x = F.col(col).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # the low bits: sampled hashes are small ones
    rows = hashes.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    data = np.zeros(1 << (bits - 3), np.uint8)
    got = rows.toArrow()  # one job; as large as the bitmap
    for b, m in zip(got["b"].to_pylist(), got["m"], strict=True):
        at = (b - 1) * 4096
        data[at : at + 4096] = np.frombuffer(m.as_buffer(), np.uint8)[: len(data) - at]
    return Bitmap(bits, data)


class Told:
    """Two bitmaps that tell most ids of a table from those that go: one of the ids that go, and one of the ids that
    stay although the first has them."""

    def __init__(self, gone: Bitmap, alarms: Bitmap):
        self.gone, self.alarms = gone, alarms

    def how(self, hashes: np.ndarray) -> np.ndarray:
        """0: stays for certain, 1: goes for certain, 2: not told."""
        return self.gone.has(hashes).astype(np.int32) * (1 + self.alarms.has(hashes))


def told(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> Broadcast | None:
    """``Told`` for the ids of ``docs``; ``gone``: ids (id). None if none go."""
    gone = gone.where("id is not null").distinct()
    n = gone.count()
    if not n:
        return None
    first = shared(gone.select(F.xxhash64("id").alias("x")), "x", n)

    @F.pandas_udf("boolean")
    def has(x: pd.Series) -> pd.Series:
        return pd.Series(first.value.has(x.to_numpy()))

    alarms = docs.select(F.col(id_col).cast("long").alias("id")).where(F.col("id").isNotNull()).where(has(F.xxhash64("id")))
    alarms = materialize(alarms.distinct().join(gone.hint("shuffle_hash"), "id", "left_anti"), "alarms")
    second = build(alarms.select(F.xxhash64("id").alias("x")), "x", alarms.count())
    return docs.sparkSession.sparkContext.broadcast(Told(first.value, second))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``gone`` (column id). Rows without an id stay.

    Exact, and texts stay where they are but for the few rows whose ids the bitmaps don't tell: these are joined with ``gone``.
    """
    bits = told(docs, gone, id_col)
    if bits is None:
        return docs

    @F.pandas_udf("int")
    def how(x: pd.Series) -> pd.Series:
        return pd.Series(bits.value.how(x.to_numpy()))

    marked = docs.withColumn("__how", F.when(F.col(id_col).isNotNull(), how(F.xxhash64(F.col(id_col).cast("long")))).otherwise(0))
    doubt = marked.where("__how = 2").drop("__how")
    ids = gone.select(F.col("id").alias("__gone"))
    sure = doubt.join(ids.hint("shuffle_hash"), doubt[id_col].cast("long") == ids["__gone"], "left_anti")
    return marked.where("__how = 0").drop("__how").unionByName(sure)


def shared(hashes: DataFrame, col: str, count: int) -> Broadcast:
    return hashes.sparkSession.sparkContext.broadcast(build(hashes, col, count))
