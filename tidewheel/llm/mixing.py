"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are summed by source; targets follow the weights, stop at ``max_repeat`` times a source's
   size, and the excess is shared again by weight (``targets``).
2. A source's documents are dealt by hash into blocks of about ``block_docs`` documents. A target is
   whole passes over the source and a rest; the rest is drawn as blocks in hashed order up to the
   target, and only the block at the edge is cut, at the document nearest to it.
3. The blocks drawn (a block of each pass counts once) are quotas by source. They are split over
   the output shards: every node of a binary tree draws, by a multivariate hypergeometric draw, how many
   blocks of each source go left. A shard's blocks are a stretch of the source's permuted order,
   so shards share none. Within a shard rows are shuffled by hash.

All draws are seeded by node, all orders by hash: reruns agree. Only block sums and quotas are
gathered by source; documents are never ordered within a source, so a hot source splits well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import materialize, n_words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_DOCS = 64
SHARDS = 16
#: Blocks of one source that one window orders; larger sources are ordered by groups of blocks.
GROUP_BLOCKS = 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, ...) -> with weight and target: a row for each source.

    Weights are dealt to the sources by code point, null last. Water filling in closed form: with
    the sources ordered by size / weight, a source is held at ``max_repeat`` times its size when the
    level reached without the held ones is above that; the held ones are a prefix of that order.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    w = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank + 1).cast("int")))
    w = w.withColumn("cap", (max_repeat * F.col("source_size")).cast("double"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    total = F.sum("source_size").over(every)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / weight_left)
    w = w.withColumn("held", F.col("cap") <= F.col("level") * F.col("weight"))
    # the first source not held sets the level of all that are not held
    w = w.withColumn("held", F.min(F.col("held").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1)
    first_free = F.min(F.when(~F.col("held"), F.col("cap") / F.col("weight"))).over(every)
    level = F.max(F.when(~F.col("held") & (F.col("cap") / F.col("weight") == first_free), F.col("level"))).over(every)
    return w.withColumn("target", F.when(F.col("held"), F.col("cap")).otherwise(F.col("weight") * level)).drop("cap", "level", "held")


def _mixed(*cols: Column) -> Column:
    """A hash that orders or deals rows; the seed is in the columns."""
    return F.xxhash64(*cols)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source_no, blocks) -> (source_no, shard, first, n): the stretch of each source's permuted
    blocks that each shard gets. Node by node the left half draws its share of all blocks without
    replacement; shards differ by one block in total at most. A node is a row for each source."""
    schema = "source_no int, node int, lo int, hi int, first long, n long"
    tree = quotas.select("source_no", F.lit(1).alias("node"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.lit(0).cast("long").alias("first"), F.col("blocks").cast("long").alias("n"))

    def split(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        node = int(key[0])
        lo, hi = int(part["lo"].iloc[0]), int(part["hi"].iloc[0])
        if hi - lo < 2:
            return part[["source_no", "node", "lo", "hi", "first", "n"]]
        part = part.sort_values("source_no")
        mid, n = (lo + hi) // 2, part["n"].to_numpy()
        rng = np.random.default_rng([seed, node])
        to_left = int(n.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(n, to_left, method="marginals") if n.sum() else n
        a = part.assign(node=2 * node, hi=mid, n=left)
        b = part.assign(node=2 * node + 1, lo=mid, first=part["first"] + left, n=n - left)
        return pd.concat([a, b])[["source_no", "node", "lo", "hi", "first", "n"]]

    for _ in range(max(0, (shards - 1).bit_length())):
        tree = tree.groupBy("node").applyInPandas(split, schema)
    return tree.select("source_no", F.col("lo").alias("shard"), "first", "n")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    shards: int = SHARDS,
    block_docs: int = BLOCK_DOCS,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken and
    places (an array of shard and order, one for each time that the document is taken).

    A null source is a source of its own, a null or empty text has size 0 and is taken in each
    whole pass with 0 words. Rows that repeat a doc_id are
    dealt to the same block, and each counts there; rows without an id are dealt by their text. Columns besides id, text
    and source are not read. An empty table gives an empty result.
    """
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("deal")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    plan = targets(sums, weights, max_repeat)
    # numpy draws from at most 10**9 blocks
    block_docs = max(block_docs, -(-2 * max_repeat * sized.count() // 10**9))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs)).cast("long")
    plan = plan.select(
        "source",
        "source_size",
        "target",
        n_blocks.alias("n_blocks"),
        F.row_number().over(by_name).alias("source_no"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
    )
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "plan")
    small = F.broadcast(plan) if plan.count() <= 100_000 else plan
    on = sized["source"].eqNullSafe(plan["source"])
    dealt = sized.join(small, on).drop(plan["source"]).withColumn("block", F.pmod(_mixed(F.lit(seed), F.col("deal")), F.col("n_blocks")))
    # words before each block in the permuted order, in two levels: groups of blocks, then blocks
    turn = _mixed(F.lit(seed), F.lit("block"), F.col("source_no"), F.col("block"))
    blocks = dealt.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("n_blocks").alias("n_blocks"), F.first("rest").alias("rest"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_blocks") / GROUP_BLOCKS)).cast("long")
    blocks = blocks.withColumn("turn", turn).withColumn("grp", F.floor((F.col("turn").cast("double") / 2.0**64 + 0.5) * groups))
    in_group = W.partitionBy("source_no", "grp").orderBy("turn", "block")
    blocks = blocks.withColumn("before", F.sum("words").over(in_group) - F.col("words")).withColumn("at", F.row_number().over(in_group) - 1)
    # the rest takes no blocks without words, so its blocks are numbered without them
    blocks = blocks.withColumn("rest_at", F.sum((F.col("words") > 0).cast("long")).over(in_group) - 1)
    blocks = materialize(blocks, "blocks")
    heads = blocks.groupBy("source_no", "grp").agg(F.sum("words").alias("gw"), F.count(F.lit(1)).alias("gn"), F.sum((F.col("words") > 0).cast("long")).alias("gr"))
    by_grp = W.partitionBy("source_no").orderBy("grp")
    heads = heads.withColumn("g_before", F.sum("gw").over(by_grp) - F.col("gw")).withColumn("g_at", F.sum("gn").over(by_grp) - F.col("gn"))
    heads = heads.withColumn("g_rest_at", F.sum("gr").over(by_grp) - F.col("gr"))
    blocks = blocks.join(heads.select("source_no", "grp", "g_before", "g_at", "g_rest_at"), ["source_no", "grp"]).select(
        "source_no", "block", "words", "rest", (F.col("before") + F.col("g_before")).alias("before"), (F.col("at") + F.col("g_at")).alias("at"),
        (F.col("rest_at") + F.col("g_rest_at")).alias("rest_at"),
    )
    # the block that crosses the rest is cut at the document nearest to it
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    blocks = materialize(blocks.withColumn("edge", edge).withColumn("whole", F.col("before") + F.col("words") <= F.col("rest")), "order")
    drawn = blocks.groupBy("source_no").agg(F.sum((F.col("edge") | (F.col("whole") & (F.col("words") > 0))).cast("long")).alias("rest_blocks"), F.count(F.lit(1)).alias("n_all"))
    quota = plan.join(drawn, "source_no").select("source_no", (F.col("passes") * F.col("n_all") + F.col("rest_blocks")).alias("blocks"))
    stretches = materialize(split_quotas(quota, shards, seed), "stretches")
    # each block of each pass, with its shard; the rest is the last pass
    passes = blocks.join(plan.select("source_no", "passes"), "source_no").join(drawn.select("source_no", "n_all"), "source_no")
    taken_rest = F.col("edge") | (F.col("whole") & (F.col("words") > 0))
    units = passes.select("source_no", "block", "edge", "rest", "before", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: (p < F.col("passes")) | taken_rest)).alias("pass"), "at", "rest_at", "n_all", "passes")
    units = units.withColumn("rank", F.col("pass") * F.col("n_all") + F.when(F.col("pass") < F.col("passes"), F.col("at")).otherwise(F.col("rest_at")))
    hit = [units["source_no"] == stretches["source_no"], units["rank"] >= stretches["first"], units["rank"] < stretches["first"] + stretches["n"]]
    n_stretches = stretches.count()
    placed = units.join(F.broadcast(stretches) if n_stretches <= 1_000_000 else stretches, hit).drop(stretches["source_no"])
    placed = placed.groupBy("source_no", "block").agg(
        F.collect_list(F.struct("pass", "shard")).alias("units"), F.max("passes").alias("u_passes"), F.max(F.when(F.col("edge"), F.col("rest") - F.col("before"))).alias("cut_at")
    )
    full = dealt.join(placed, ["source_no", "block"], "left")
    # within the block at the edge: documents in hashed order, each that still fits
    edge_docs = full.where("cut_at is not null")
    turn_doc = _mixed(F.lit(seed), F.lit("doc"), F.col("deal"))
    by_turn = F.sort_array(F.collect_list(F.struct(turn_doc.alias("turn"), F.col("doc_id").alias("id"), F.col("size").alias("size"), F.struct(*full.columns).alias("row"))))
    picked = edge_docs.groupBy("source_no", "block").agg(by_turn.alias("list"), F.first("cut_at").alias("room"))
    picked = picked.withColumn("sizes", F.transform("list", lambda x, i: F.struct(x["size"].alias("size"), i.alias("i"))))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<int>").alias("at"))
    fits = F.aggregate(
        "sizes", start,
        lambda a, x: F.when(x["size"] <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), F.concat(a["at"], F.array(x["i"])).alias("at"))).otherwise(a),
    )
    picked = picked.select("list", "sizes", fits.alias("got"))
    # and one more if that comes nearer to the target than the room that is left
    near = F.filter("sizes", lambda x: ~F.coalesce(F.array_contains("got.at", x["i"]), F.lit(False)) & (x["size"] < 2 * F.col("got.room")))
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["size"] - F.col("got.room")).alias("off"), x["i"].alias("i"))))
    taken_at = F.concat("got.at", F.array_compact(F.array(best["i"])))
    cuts = picked.withColumn("at", taken_at).select(F.inline(F.transform("list", lambda x, i: F.struct(x["row"].alias("row"), F.coalesce(F.array_contains("at", i), F.lit(False)).alias("in_rest")))))
    cuts = cuts.select("row.*", "in_rest")
    every = full.where("cut_at is null").withColumn("in_rest", F.lit(True)).unionByName(cuts)
    used = F.filter(F.coalesce("units", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda u: (u["pass"] < F.col("passes")) | F.col("in_rest"))
    spot = F.transform("used", lambda u: F.struct(u["shard"].alias("shard"), _mixed(F.lit(seed), F.lit("shuffle"), u["shard"], u["pass"], F.col("doc_id")).alias("order")))
    return every.withColumn("used", used).select("doc_id", "source", "size", "source_size", "target", (F.size("used") * F.col("size")).alias("taken"), spot.alias("places"))


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time that a document is taken, with its shard
    and order. Documents that the mix doesn't take are left out."""
    places = mix(docs, shards=shards, seed=seed, id_col=id_col, **how).select(F.col("doc_id").alias("__mix_id"), F.explode("places").alias("__place"))
    return docs.join(places.hint("merge"), docs[id_col].eqNullSafe(places["__mix_id"])).drop("__mix_id").withColumnRenamed("__place", "place")
