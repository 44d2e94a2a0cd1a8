"""Merkle manifest of a table of documents by lag and lead windows.

Every row is a leaf. Leaves of a source stand in the order of their ids; every 16 consecutive nodes become their
parent's digest, level by level, until one is left, and the sources' last nodes become the root in the same way.
A level is one window pass: in each run of siblings, columns of fixed lag and lead offsets, masked by the node's slot
and its run's length, are its siblings to the left and right, and rows of slot 0 hash themselves and what follows as the
parent. A run is a window partition of its own, so a source that a third of all rows share is spread like any other.
Places inside sources come from one sort by ranges and the counts of its partitions, never from a window over a source.

Proofs go down the tree: a node hands the siblings of its ancestors to its children, 16 times fewer rows on each level up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import fold, forget, materialize

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as its UTF-8 length, a colon and itself, or a dash for null."""
    items = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*items), 256)


def leaves(docs: DataFrame, tamper_every: int = 5) -> DataFrame:
    """(source, doc_id, digest, changed): ``changed`` is the leaf of a text in lower case where
    ``tamper_every`` divides the id's fold, and null elsewhere, also for rows without an id."""
    rest, text = [F.col(c) for c in FIELDS[:-1]], F.col(FIELDS[-1]).cast("string")
    tampered = F.when(fold("doc_id", tamper_every) == 0, leaf_digest(*rest, F.translate(text, UPPER, LOWER)))
    return docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*rest, text).alias("digest"), tampered.alias("changed"))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with gid (a number of the group that ascends with it), idx (place in the group, from 0) and n (size of the group).

    Rows are sorted once by ranges. Equal rows are dealt apart by a last sort key, so no range grows with their number.
    """
    salted = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    key = [F.col(c).asc_nulls_first() for c in (group, *order)] + [F.col("__salt")]
    placed = materialize(salted.repartitionByRange(*key).sortWithinPartitions(*key).drop("__salt").withColumn("pos", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("pos", 33)
    parts = placed.groupBy(task.alias("__task"), F.col(group).alias("__group")).agg(F.min("pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    own = W.partitionBy("__group")
    parts = parts.select(
        "__task", "__group", "__first",
        F.min("__first").over(own).alias("gid"),
        F.sum("__n").over(own).alias("n"),
        (F.sum("__n").over(own.orderBy("__task").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")).alias("__before"),
    )
    met = placed.join(parts, (task == parts["__task"]) & placed[group].eqNullSafe(parts["__group"]))
    return met.select(*rows.columns, "gid", (F.col("pos") - F.col("__first") + F.col("__before")).alias("idx"), "n")


def siblings(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """``nodes`` (gid, idx, n, digest) with run, slot, left and right: the digests beside each node in its run, joined."""
    run, slot = F.floor(F.col("idx") / fan), F.col("idx") % fan
    placed = nodes.withColumns({"run": run, "slot": slot, "size": F.least(F.lit(fan), F.col("n") - run * fan)})
    w = W.partitionBy("gid", "run").orderBy("idx")
    left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(w)).otherwise("") for k in range(fan - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < F.col("size"), F.lead("digest", k).over(w)).otherwise("") for k in range(1, fan)]
    return placed.withColumns({"left": F.concat(*left), "right": F.concat(*right)}).drop("size")


def forest(nodes: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels of all groups' trees, from the leaves up; a group's tree ends at the level where it has one node."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = siblings(levels[-1].where("n > 1").select("gid", "idx", "n", "digest"), fan)
        parents = below.where("slot = 0").select("gid", F.col("run").alias("idx"), F.ceil(F.col("n") / fan).alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        levels.append(materialize(parents, "nodes"))
        most = -(-most // fan)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(gid, digest): the last node of each group."""
    ends = [t.where("n = 1").select("gid", "digest") for t in levels]
    found = ends[0]
    for t in ends[1:]:
        found = found.unionByName(t)
    return found


def with_paths(levels: list[DataFrame], top: DataFrame, fan: int = FAN) -> DataFrame:
    """The leaves with path: (left, right) at every level from the leaf up. ``top`` has gid, the path above each group's
    last node, and other columns to hand down."""
    handed = [c for c in top.columns if c not in ("gid", "path")]
    paths = None
    for k, level in reversed(list(enumerate(levels))):
        own = [c for c in level.columns if c not in ("gid", "idx", "n")]
        here = level.where("n = 1").join(top, "gid").select("gid", "idx", *own, "path", *handed)
        if paths is not None:
            above = paths.drop("digest").withColumnRenamed("idx", "run")
            step = F.array(F.struct("left", "right"))
            inner = siblings(level.where("n > 1"), fan).join(above, ["gid", "run"])
            here = here.unionByName(inner.select("gid", "idx", *own, F.concat(step, "path").alias("path"), *handed))
        paths = materialize(here, "paths") if k else here
    return paths


def manifest(docs: DataFrame, tamper_every: int = 5, fan: int = FAN) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    ``path`` has the siblings (left, right) from the leaf up to the root. Rows whose text was changed after the manifest
    was made (see ``leaves``) are folded from the changed leaf with the siblings of the unchanged tree, so they verify only if
    the change left the text as it was. Null values are dashes in leaves. A null source is a source of its own, the first; rows
    without an id stand first in their source and are never changed. Rows that repeat an id stand by their digests. A
    lone document is its source's subroot, a lone source's subroot the root. An empty table gives an empty result. Other
    columns are not read, whatever their names.
    """
    made = materialize(leaves(docs, tamper_every), "leaves")
    nodes = materialize(ranked(made, "source", "doc_id", "digest"), "ranked")
    forget(made)
    levels = forest(nodes.drop("source"), fan)
    sources = materialize(ranked(tops(levels).select(F.lit(0).alias("all"), F.col("gid").alias("source_gid"), F.col("digest")), "all", "source_gid"), "sources")
    upper = forest(sources.drop("all"), fan)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = tops(upper).select("gid", nothing.alias("path"), F.col("digest").alias("root"))
    subroots = with_paths(upper, root, fan).select(F.col("source_gid").alias("gid"), "path", F.col("digest").alias("subroot"), "root")
    found = with_paths(levels, materialize(subroots, "subroots"), fan)
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))
    beside = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", F.sha2(beside, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return found.drop("path")


def _sql(depth: int = 5, source_depth: int = 3) -> str:
    """The manifest in DuckDB's SQL, levels written out: up to 16 ** depth rows of a source, 16 ** source_depth sources."""

    def item(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(item(v) for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"

    def level(t: str, k: int) -> str:
        """Nodes of level k + 1 from those of level k; a tree of one node stays."""
        return f"""{t}{k}r as (select g, i // 16 as run, max(n) as n, list(h order by i) as hs from {t}{k} group by 1, 2),
{t}{k + 1} as (select g, run as i, (n + 15) // 16 as n, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {t}{k}r)"""

    def beside(t: str, k: int, node: str) -> str:
        """Left and right siblings of the ancestor of ``node`` on level k."""
        at = f"({node}.i // {16**k})"
        return f"left join {t}{k}r {t}r{k} on {t}r{k}.g = {node}.g and {t}r{k}.run = {at} // 16 and {t}r{k}.n > 1"

    def sides(t: str, k: int, node: str) -> tuple[str, str, str]:
        slot, hs = f"(({node}.i // {16**k}) % 16)", f"{t}r{k}.hs"
        return f"coalesce(array_to_string(list_slice({hs}, 1, {slot}), ''), '')", f"coalesce(array_to_string(list_slice({hs}, {slot} + 2, 16), ''), '')", f"{hs} is not null"

    steps = [(*sides("d", k, "d0"), k) for k in range(depth)] + [(*sides("s", k, "s0"), k) for k in range(source_depth)]
    folds, last = [], "coalesce(c, h)"
    for j, (left, right, there, _) in enumerate(steps):
        folds.append(f"f{j} as (select *, case when t{j} then sha256(l{j} || {last} || r{j}) else {last} end as v{j} from {'met' if not j else f'f{j - 1}'})")
        last = f"v{j}"
    return f"""
with crc_table as (select list(v order by b) as entries from (
 select b, list_reduce([b] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: case when (x & 1) = 1 then xor(3988292384, x >> 1) else x >> 1 end) as v from (select b::bigint as b from range(256) t(b)))),
leaf as (select doc_id, source, {leaf("text")} as h, case when doc_id is not null and xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint),
  lambda x, y: xor(x >> 8, entries[(xor(x, y) & 255) + 1]))) % 5 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as c from documents, crc_table),
d0 as (select doc_id, c, h, dense_rank() over (order by source nulls first) as g, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i, count(*) over (partition by source) as n from leaf),
{", ".join(level("d", k) for k in range(depth))},
s0 as (select 0 as g, d.g as source_g, row_number() over (order by d.g) - 1 as i, count(*) over () as n, h from d{depth} d),
{", ".join(level("s", k) for k in range(source_depth))},
met as (select doc_id, c, d0.h, s0.h as subroot, top.h as root, {", ".join(f"{left} as l{j}, {right} as r{j}, {there} as t{j}" for j, (left, right, there, _) in enumerate(steps))}
 from d0 join s0 on s0.source_g = d0.g cross join s{source_depth} top {" ".join(beside("d", k, "d0") for k in range(depth))} {" ".join(beside("s", k, "s0") for k in range(source_depth))}),
{", ".join(folds)}
select doc_id, h as leaf, subroot, root, sha256({" || ".join(f"l{j} || r{j}" for j in range(len(steps)))}) as proof_sha256, {last} as folded_root, {last} = root as verified from f{len(steps) - 1}
"""


SQL = _sql()
