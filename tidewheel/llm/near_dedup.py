"""MinHash near-dedup with tensored banding.

A document's set is its distinct word shingles. Instead of one hash function for every table, there are two
small collections of ``TUPLES`` tuples of ``ROWS`` minhashes each; a table's key combines a tuple
of the first collection with one of the second. ``TUPLES ** 2`` tables thus cost ``2 * TUPLES * ROWS``
minhashes. Two sets of similarity s share a key with probability ``(1 - (1 - s**ROWS)**TUPLES)**2``:
0.9996 at 0.8 for the values here. Minhashes come from rounds of bins: a round deals the set over all bins, and a
bin keeps the smallest hash of the first round that reaches it.

Candidates are confirmed on full sets; equal sets are one node from the start. A pair that shares a key is found
without forming all pairs of a key:

1. Every node of a key is compared with the key's hub, the one whose tuples are the most common.
2. Where nodes of one hub are still in different components, two of them can only be alike if their differences
   from the hub overlap: both sets differ from each other by at most a ninth of their sizes (at 0.8), so a bound on
   the overlap follows from sizes alone. By the prefix principle such a pair shares one of the first few
   elements of both differences, in any order that is the hub's, and what comes after the first
   shared one must be enough for the overlap. Elements that few of the hub's nodes have in their differences come first, by
   how often slots of elements occur in all sets: the order decides how many nodes meet, not which links are found. Nodes that share an element form smaller groups, of which only nodes
   with a possible partner stay; small groups are compared pair by pair, large ones with a hub of their own, and so on.

No candidate is left out: whatever is not compared is either in one component already or provably not alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .base import PY_WS, map_texts, materialize, text_or_empty
from .components import components

SHINGLE = 5
THRESHOLD = 80
TUPLES = 12
ROWS = 3
#: Nodes of a group whose pairs are tested by sizes and places, and compared where these allow a link; larger groups get a hub.
SMALL = 512
#: Pairs whose differences leave a task at once.
PAIRS_AT_ONCE = 1000
#: Elements of sets are counted in so many slots (a power of two), whatever the input.
SLOT_BITS = 20
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
#: What str.split() takes for white space beyond the contract's.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
Batches = Iterator[pd.DataFrame]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class WordHashes(dict):
    """64-bit hashes of words; of two generations of ``limit`` words the older one goes."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def lower(text: str) -> str:
    """A-Z in lower case, and no other letter."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_words(text: str) -> list[str]:
    """Words of the contract: runs without space, tab, line feed, vertical tab, form feed or return."""
    if not OTHER_SPACE.search(text):
        return text.split()
    for c in PY_WS[:-1]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer words than ``k`` are one shingle."""
    w = split_words(lower(text))
    if not w:
        return np.zeros(0, U)
    h = hashes(w)
    n = max(1, len(h) - k + 1)
    out = np.full(n, U(min(k, len(h))), U)
    for j in range(min(k, len(h))):
        out = mix(out * GOLD + h[j : j + n])
    return np.unique(out)


BINS = 2 * TUPLES * ROWS
EDGES = np.arange(BINS + 1, dtype=np.uint64) << U(57)


def minhashes(own: np.ndarray) -> np.ndarray:
    """``BINS`` minhashes of a set that isn't empty. In each round an element has one bin and one value."""
    least = np.full(BINS, np.iinfo(np.uint64).max, U)
    first, rounds = 1, -(-9 * BINS // len(own))
    while True:
        r = np.arange(first, first + rounds, dtype=np.uint64)[:, None]
        h = mix(own + r * GOLD)
        key = ((h >> U(32)) * U(BINS) >> U(32) << U(57)) | (r << U(41)) | ((h & U(0xFFFFFFFF)) << U(9))
        key = np.sort(key, axis=None)
        at = np.searchsorted(key, EDGES)
        some = at[1:] > at[:-1]
        least[some] = np.minimum(least[some], key[at[:-1][some]])
        if (least != np.iinfo(np.uint64).max).all():
            return least
        first, rounds = first + rounds, 2 * rounds


def tuples(own: np.ndarray) -> np.ndarray:
    """The names of a set's tuples: ``TUPLES`` of the first collection, then of the second; the lowest bit tells which."""
    half = minhashes(own).reshape(2 * TUPLES, ROWS)
    names = np.arange(1, 2 * TUPLES + 1, dtype=np.uint64)
    for r in range(ROWS):
        names = mix(names * GOLD + half[:, r])
    side = np.arange(2 * TUPLES, dtype=np.uint64) // U(TUPLES)
    return (names & ~U(1) | side).view(np.int64)


def set_names(own: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    return int(mix(own).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(mix(own + U(77))).view(np.int64)) if len(own) else 0


def _sets(k: int) -> Callable[[], Callable[[list[str]], dict]]:
    def start() -> Callable[[list[str]], dict]:
        hashes = WordHashes()

        def make(texts: list[str]) -> dict:
            own = [shingles(t, k, hashes) for t in texts]
            one, two = zip(*map(set_names, own), strict=True)
            return {"n_shingles": [len(s) for s in own], "set_id": one, "set_id2": two, "tuples": [tuples(s) if len(s) else None for s in own]}

        return make

    return start


FULL = "n_shingles long, set_id long, set_id2 long, members binary"


def _full_sets(k: int, wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sets of texts as bytes, 48 bits of each shingle's hash; of texts whose x the bitmap ``wanted`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ok = wanted.value.has(batch.column("x").to_numpy())
            picked = batch.column("text").filter(pa.array(ok))
            for at in range(0, len(picked), 500):
                own = [shingles(t, k, hashes) for t in picked.slice(at, 500).to_pylist()]
                raw = [np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for s in own]
                one, two = zip(*map(set_names, own), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in own], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(raw, pa.binary())], names=["n_shingles", "set_id", "set_id2", "members"])

    return run


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def slots(elements: np.ndarray) -> np.ndarray:
    return (elements >> U(16)).astype(np.int64) & ((1 << SLOT_BITS) - 1)


def occurrences(sets: DataFrame) -> Broadcast:
    """How often elements of each slot occur in all sets beyond the mean of all slots; 0 where that may be chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                n += np.bincount(slots(_unpack(b"".join(batch.column(0).slice(at, 1000).to_pylist()))), minlength=len(n)).astype(np.int32)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    mean = sets.agg(F.coalesce(F.sum(F.octet_length("members")), F.lit(0))).first()[0] / 6 / (1 << SLOT_BITS)
    counts = sets.select("members").mapInArrow(run, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") > mean + 4 * mean**0.5 + 1).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int32)
    out[got.column("slot").to_numpy()] = np.minimum(got.column("n").to_numpy() - int(mean), 2**31 - 1)
    return sets.sparkSession.sparkContext.broadcast(out)


def prefix(hub: np.ndarray, own: np.ndarray, threshold: int, rank: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[bool, int, np.ndarray]:
    """Whether two sets are alike, how many elements only one of them has, and the first elements of that
    difference, one of which ``own`` shares with every set that is like it and not settled by the hub.

    ``rank`` gives what the elements that the hub lacks, and those that it has alone, are ordered by. It must be the same for an element whatever ``own`` is.

    With c = (100 - threshold) / (100 + threshold), sets x and y are alike if their difference is at most
    c (|x| + |y|). The overlap of their differences X and Y from the hub is (|X| + |Y| - |difference of x and y|) / 2.
    """
    at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
    in_hub = hub[at] == own
    in_own = np.zeros(len(hub), bool)
    in_own[at[in_hub]] = True
    n, m, common = len(hub), len(own), int(in_hub.sum())
    alike = 100 * common >= threshold * (n + m - common)
    difference = n + m - 2 * common
    c = (100 - threshold) / (100 + threshold)
    overlap = difference - c * m * (1 + 100 / threshold)  # a partner's difference is at least as large as the overlap
    if alike:  # and a partner that the hub doesn't settle isn't like the hub
        overlap = max(overlap, (difference + c * (n - m)) / 2)
    k = difference - max(1, int(np.ceil(overlap - 1e-6))) + 1
    lacked, alone = own[~in_hub], hub[~in_own]
    first = np.concatenate([lacked, alone])
    if rank is not None:
        first = first[np.argsort(rank(lacked, alone), kind="stable")]
    return alike, difference, first[: max(0, k)]


COMPARED = "a long, b long, alike boolean, n long, d long, first array<long>"


def _compare(threshold: int, common: Broadcast | None = None) -> Callable[[Batches], Batches]:
    """Pairs of a hub a and a node b with both sets -> COMPARED; without ``first`` where it isn't asked for. ``common``:
    of ``occurrences``, by which and by the number m of the hub's nodes it is ordered."""

    def ranked(m: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """About how many of the hub's nodes have an element in their differences."""
        n = lambda x: np.minimum(common.value[slots(x)], m)
        return lambda lacked, alone: np.concatenate([n(lacked), m - n(alone)])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, len(batch), PAIRS_AT_ONCE):
                part, rows = batch.iloc[at : at + PAIRS_AT_ONCE], []
                for a, b, x, y, more, m in zip(part["a"], part["b"], part["members_a"], part["members_b"], part["more"], part["m"] if common else part["more"], strict=True):
                    hub, own = _unpack(x), _unpack(y)
                    alike, d, first = prefix(hub, own, threshold, ranked(m) if common and more else None)
                    rows.append((a, b, alike, len(own), d, first.view(np.int64) if more else None))
                yield pd.DataFrame(rows, columns=["a", "b", "alike", "n", "d", "first"])

    return run


def compared(pairs: DataFrame, sets: DataFrame, threshold: int, common: Broadcast | None = None) -> DataFrame:
    """(a, b), with ``common`` hubs and their nodes -> COMPARED for each pair."""
    a, b = (sets.select(F.col("node").alias(c), F.col("members").alias(f"members_{c}")).hint("merge") for c in "ab")
    if common is None:
        pairs = pairs.select("a", "b", F.lit(False).alias("more"), F.lit(0).cast("long").alias("m"))
    else:
        pairs = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).hint("merge"), "a").select("a", "b", F.lit(True).alias("more"), "m")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "more", "m", "members_a", "members_b").mapInPandas(_compare(threshold, common), COMPARED)


def small_pairs(groups: DataFrame, threshold: int) -> DataFrame:
    """(g, node, root, n, s, t) of groups of bounded size -> (a, b) that have to be compared."""
    listed = groups.groupBy("g").agg(F.collect_list(F.struct("node", "root", "n", "s", "t")).alias("l"))

    def may(x: Column, y: Column) -> Column:
        sizes = 100 * F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])
        return (x["node"] < y["node"]) & (x["root"] != y["root"]) & (x["s"] <= y["t"]) & (y["s"] <= x["t"]) & sizes

    each = F.transform("l", lambda x: F.transform(F.filter("l", lambda y: may(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))))
    return listed.select(F.inline(F.flatten(each))).distinct()


def promising(parts: DataFrame) -> DataFrame:
    """(g, node, root, s, t, ...) -> the rows that another row of the group may be alike, with the group's size m.

    Two rows may be alike if s of each is at most t of the other. Rows of a group are summed up by classes of s, of
    which there are few, so every row is tested against classes and not against rows.
    """
    size = F.floor(2 * F.log2(1 + F.abs("s"))).cast("int")
    by_class = parts.groupBy("g", (F.signum("s") * size).cast("int").alias("k")).agg(F.min("s").alias("lo"), F.max("t").alias("hi"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    classes = by_class.groupBy("g").agg(F.collect_list(F.struct("lo", "hi", "r1", "r2")).alias("classes"), F.min("r1").alias("r1"), F.max("r2").alias("r2")).where("r1 < r2")
    fits = F.exists("classes", lambda x: (x["lo"] <= F.col("t")) & (x["hi"] >= F.col("s")) & ((x["r1"] != F.col("root")) | (x["r2"] != F.col("root"))))
    left = materialize(parts.join(classes.select("g", "classes").hint("merge"), "g").where(fits).drop("classes"), "parts")
    several = left.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("g", "m")
    return left.join(several.hint("merge"), "g")


def met_twice(level: DataFrame) -> Callable[[str], Column]:
    """Tells by a bitmap the hashes of a hub a and an element of which ``level`` has one row for certain: most of them, and they lead nowhere."""
    several = level.select("a", F.explode("first").alias("e")).select(F.xxhash64("a", "e").alias("g"))
    several = materialize(several.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"), "shared")
    bits = bitmaps.shared(several, "g", several.count())

    @F.pandas_udf("boolean")
    def has(g: pd.Series) -> pd.Series:
        return pd.Series(bits.value.has(g.to_numpy()))

    return has


def similar_components(keyed: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(g, node, w) -> (id, root): components of the similar nodes among those that share a group.

    ``sets``: node and members. ``w`` is larger for better hubs."""
    hubs = keyed.groupBy("g").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    held = keyed.select("g", "node").join(hubs.hint("merge"), "g").select("a", F.col("node").alias("b")).where("a != b").distinct()
    held = materialize(held, "candidates")
    roots, used, done, common = None, None, None, occurrences(sets)
    either = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        # a: a hub, b: another node of one of its groups
        level = materialize(compared(held, sets, threshold, common), "compared")
        roots = linked(roots, level.where("alike").select("a", "b"))
        root = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        placed = level.join(root("b"), "b", "left").withColumn("root_b", F.coalesce("root_b", "b"))
        hubs = materialize(level.select("a").distinct(), "hubs")
        mine = hubs.join(root("a"), "a", "left").withColumn("root_a", F.coalesce("root_a", "a"))
        # hubs that have nodes of another component; of these, what shares an element of the differences
        open_hubs = placed.join(mine, "a").where("root_a != root_b").select("a").distinct()
        met = met_twice(level)
        parts = placed.join(open_hubs, "a", "left_semi").select("a", F.col("b").alias("node"), F.col("root_b").alias("root"), "n", "d", F.posexplode("first").alias("at", "e"))
        s = (100 + threshold) * F.col("d") - (100 - threshold) * F.col("n")
        parts = parts.withColumn("g", F.xxhash64("a", "e")).where(met("g"))
        parts = parts.select("g", "node", "root", "n", "d", s.alias("s"), (2 * (100 + threshold) * (F.col("d") - F.col("at")) - s).alias("t"))
        parts = materialize(promising(parts), "groups")
        pairs = small_pairs(parts.where(F.col("m") <= small), threshold).join(level.select(*either), ["a", "b"], "left_anti")
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = compared(pairs, sets, threshold)
        roots = linked(roots, materialize(found.where("alike").select("a", "b"), "links"))
        large = parts.where(F.col("m") > small)
        if large.isEmpty():
            return roots
        new = level.select(*either).unionByName(pairs)
        done, used = (new, hubs) if done is None else (done.unionByName(new), used.unionByName(hubs))
        # hubs of their own for large groups: the nearest to the old one that hasn't been a hub
        large = large.join(used.select(F.col("a").alias("node"), F.lit(1).alias("was")).distinct(), "node", "left")
        hubs = large.groupBy("g").agg(F.max_by("node", F.struct(F.col("was").isNull(), -F.col("d"), -F.col("node"))).alias("a"))
        held = large.select("g", "node").join(hubs, "g").select("a", F.col("node").alias("b")).where("a != b").distinct()
        held = materialize(held, "candidates")


def linked(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, root) after more links."""
    if roots is None:
        return materialize(components(links), "roots")
    if links.isEmpty():
        return roots
    return materialize(components(links.unionByName(roots.select(F.col("root").alias("a"), F.col("id").alias("b")))), "roots")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A null text, or one without words, has the empty set and is linked with nothing: its component is itself. A
    text with fewer words than ``shingle`` has one shingle. Rows that repeat an id are rows of their own, with the
    component of their own text. A row without an id belongs to the component of its text; where no row of the
    component has an id, component_id is null and the rows are kept. Other columns are not read. An empty
    table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    name = ["set_id", "set_id2", "n_shingles"]
    made = materialize(map_texts(own, "n_shingles long, set_id long, set_id2 long, tuples array<long>", _sets(shingle)), "minhash")
    brief = made.drop("tuples")
    # equal sets have equal tuples
    classes = made.where("n_shingles > 0").groupBy(*name).agg(F.min("doc_id").alias("least"), F.first("tuples").alias("tuples"))
    firsts = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    classes = firsts.drop("tuples")
    # a tuple that no other class has leads nowhere
    each = firsts.select("node", F.explode("tuples").alias("t"))
    shared = each.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    found = each.join(shared.hint("merge"), "t").groupBy("node").agg(F.collect_list("t").alias("t"), F.sum("m").alias("w"))
    side = lambda bit: F.filter("t", lambda x: x.bitwiseAND(F.lit(1)) == bit)
    found = materialize(found.select("node", "w", side(0).alias("one"), side(1).alias("two")).where("size(one) > 0 and size(two) > 0"), "tuples")
    # a table's key: a tuple of each collection
    keyed = found.select("node", "w", F.explode("one").alias("x"), "two").select("node", "w", "x", F.explode("two").alias("y")).select("node", "w", F.xxhash64("x", "y").alias("g"))
    wanted = materialize(classes.join(found.select("node"), "node"), "wanted")
    bits = bitmaps.shared(wanted.select(F.xxhash64("least").alias("x")), "x", wanted.count())
    full = own.select(F.xxhash64("doc_id").alias("x"), "text").mapInArrow(_full_sets(shingle, bits), FULL)
    sets = materialize(full.groupBy(*name).agg(F.first("members").alias("members")).join(wanted.hint("merge"), name).select("node", "members"), "members")
    roots = similar_components(keyed, sets, threshold, small)
    by_class = classes.join(roots, F.col("node") == F.col("id"), "left").withColumn("root", F.coalesce("root", "node")).drop("id")
    least = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = materialize(by_class.join(least, "root").select(*name, "component_id"), "components")
    out = brief.join(by_class.withColumn("found", F.lit(True)), name, "left").withColumn("component_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay. Rows without an
    id stay; of rows that repeat an id all stay if one of them is kept."""
    found = near_dedup(docs, id_col=id_col, **how)
    kept = found.groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("kept"))
    return bitmaps.without(docs, kept.where("not kept").select("id"), id_col)
