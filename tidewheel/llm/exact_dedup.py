"""Exact dedup by a tree merge of sorted digest runs.

Every input partition first reduces its rows to sorted runs of distinct digests with the smallest id, one run for
each range of digests. Ranges are as many as partitions, so no task ever holds more than its share of all
digests. Runs of one range then meet in binomial rounds: in a round the runs whose numbers differ in the lowest
``bits`` bits go to one task, which merges them in order (a multiway merge of ``2 ** bits`` runs: rows are sorted
within the partition and neighbours compared); of equal digests the smallest id and the summed count survive. A
round reads at most one row for each digest and run, so a text that a third of all rows hold costs no more than any
other. Only digests and ids move; texts stay where they are.

Digests are verified at every level: runs merge on SHA-256, an independent 64-bit hash and the
length together, so two texts with the same SHA-256 but another check value stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import WS, materialize, text_or_empty

KEY = ["text_sha256", "check", "length"]
#: Texts with more copies are hot: there are fewer of them than rows / HOT, whatever the table.
HOT = 1_000_000


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest columns, run): one row for each row of ``docs``; run is the input partition."""
    norm = F.regexp_replace(text_or_empty(text_col), WS, " ")
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.xxhash64("norm").alias("check"),
        F.length("norm").alias("length"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(digests: DataFrame, bits: int = 3) -> DataFrame:
    """(digest columns, keep_id, group_size): one row for each distinct text."""
    top = digests.agg(F.max("run")).first()[0] or 0
    n_ranges = top + 1
    span = F.floor(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("double") / 2.0**32 * n_ranges).cast("int").alias("span")
    packed = digests.select("run", span, F.unhex("text_sha256").alias("digest"), "check", "length", "doc_id")
    key = ["span", "run", "digest", "check", "length"]
    runs = packed.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    order = F.col("keep_id").asc_nulls_last()
    same = W.partitionBy(*key).orderBy(order)
    while True:
        top >>= bits
        # runs meet where their range and what is left of their number are the same; equal digests are neighbours
        met = runs.withColumn("run", F.shiftright("run", bits)).repartition("span", "run").sortWithinPartitions(*key, order)
        whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        runs = met.withColumn("nth", F.row_number().over(same)).withColumn("group_size", F.sum("group_size").over(whole)).where("nth = 1").drop("nth")
        if not top:
            return runs.select(F.lower(F.hex("digest")).alias("text_sha256"), "check", "length", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts are copies of each other. Rows that repeat an
    id and its text are all marked as kept if that id is the smallest; ``drop_copies`` leaves one.
    A null id never wins against another id. Rows of texts with more than ``hot`` copies are joined
    by broadcast, so no task gets all rows of such a text. An empty table gives an empty result. Other columns
    of ``docs`` are not read, whatever their names.
    """
    digests = materialize(digest_runs(docs, id_col, text_col), "digests")
    merged = materialize(merge_runs(digests, bits), "merged")
    digests, many = digests.drop("run"), F.col("group_size") > hot
    every = digests.join(merged.where(~many), KEY)
    top = merged.where(many)
    if not top.isEmpty():
        # rows of hot texts meet their few digests where they are; only the others are shuffled by digest
        every = digests.join(F.broadcast(top.select(KEY)), KEY, "left_anti").join(merged.where(~many), KEY).unionByName(digests.join(F.broadcast(top), KEY))
    return every.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay. Of rows that repeat an id and its text one
    stays. Rows without an id: one of each text that no row with an id has. An empty table stays empty."""
    found = materialize(exact_dedup(docs, id_col, text_col), "found")
    per = found.groupBy("doc_id").agg(F.max((~F.col("kept")).cast("int")).alias("some_go"), F.count(F.lit(1)).alias("n"))
    per = materialize(per.where("some_go = 1 or n > 1 or doc_id is null"), "ids")
    # rows whose id stands for one row, which goes, are dropped; all rows of other ids are looked at again
    gone = per.where("doc_id is not null").select(F.col("doc_id").alias("__id"))
    once = docs.where(F.col(id_col).isNotNull()).join(gone, docs[id_col].cast("long") == gone["__id"], "left_anti")
    again = per.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))
    if again.isEmpty():
        return once
    rows = docs.join(again, docs[id_col].cast("long").eqNullSafe(again["__id"]), "left_semi").withColumn("__norm", F.sha2(F.regexp_replace(text_or_empty(text_col), WS, " "), 256))
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__norm2")).distinct()
    kept = rows.join(stay, rows[id_col].cast("long").eqNullSafe(stay["__id"]) & (rows["__norm"] == stay["__norm2"]), "left_semi")
    return once.unionByName(kept.dropDuplicates([id_col, "__norm"]).drop("__norm"))


SQL = r"""
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
 doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents) d
"""
