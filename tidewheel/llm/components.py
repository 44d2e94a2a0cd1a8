"""Connected components by hooking and pointer jumping, as joins over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, materialize

#: Edges that a task contracts together.
AT_ONCE = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected -> (id, root): the smallest id reachable, for every id that has an edge.

    Alternates "large star" and "small star" rounds until only stars are left; an id's links to larger
    neighbours move to its smallest one, so the number of rounds grows as the logarithm of the
    longest chain and no component is gathered in one task: a round only takes minima by id. Edges that a task
    reads together are contracted to stars first, which saves rounds.
    """
    pairs = materialize(contracted(edges.where("a != b").select(F.col("a").cast("long").alias("v"), F.col("b").cast("long").alias("u"))).distinct(), "edges")
    while not are_stars(pairs):
        # large star: every neighbour larger than the node links to the smallest of its neighbourhood
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u != v")
        found = materialize(small.select("v", "u").distinct(), "edges")
        forget(pairs)
        pairs = materialize(contracted(found), "edges")
        forget(found)
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (v, u): every id u that isn't the smallest of its component, with that one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.concatenate([root[x], root[y]]), np.concatenate([low, low]))
        while (root[root] != root).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[leaf]], ids[leaf]


def contracted(pairs: DataFrame) -> DataFrame:
    """(v, u) with the same components: of each ``AT_ONCE`` edges that a task reads their stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            v, u = stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=["v", "u"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return pairs.select("v", "u").mapInArrow(run, "v long, u long")


def are_stars(pairs: DataFrame) -> bool:
    """Whether every u of (v, u), v < u, has one v, which is no u itself: what the rounds of ``components`` lead to and leave as it is."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("n"), F.lit(0).alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("root")))
    return ends.groupBy("id").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n + root > 1").count() == 0
