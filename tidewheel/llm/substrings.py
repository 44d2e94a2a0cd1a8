"""Exact substring dedup: a suffix order of the texts, as deep as the shortest repeat.

Only the order of suffixes by their first ``width`` bytes matters, and of that only where it is
shared by two documents. So the difference cover is chosen by content: every window of ``width`` bytes samples one of
the cores (strings of ``CORE`` bytes) in it, the one that the smallest hash of shorter strings in the window points at.
Two equal windows sample the same place, which is what a difference cover is for, and about one suffix
in thirteen is sampled instead of two in three.

0. Of equal texts only the smallest document is looked at; the others go as a whole.
1. Sampled suffixes get a first name, the core's hash. Names are sorted within ranges of names, packed as bytes;
   those of one document only are dropped.
2. Recursion on names: a sampled suffix's second name is that of the triple left context, core and
   right context, as far as any window with the core reaches. All but the smallest document of a second
   name repeat its whole context.
3. Where a first name has several second names, the other suffixes (windows that start before
   the sampled place) are merged in: they are sorted by their first ``width`` bytes within the first
   name, and equal neighbours compared. Bytes are read for these places alone. Of first names with very many contexts every
   window has half of what it holds beside the core on the left or on the right of it: contexts that agree in that half
   are merged by themselves. Only where these are very many, too, the windows of that half are spread.

Names are hashes of 64 bits, with a check of 32 more for second names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .base import forget, materialize, text_or_empty

WIDTH = 50
CORE = 32
#: First names with more contexts than this are parted by the bytes beside the core; parts that have more still, by window.
HOT_CONTEXTS = 1000
CHUNK = 1 << 19
#: Documents that are summed up before rows leave a task.
AT_ONCE = 2500
#: Bytes of text whose first names are sorted in one task.
RANGE_BYTES = 1 << 25

U = np.uint64
LOW = U(0xFFFFFFFF)
BASE = 0x9E3779B97F4A7C15
CONTEXT = np.random.default_rng(13).integers(0, 2**64, (2, 256), dtype=np.uint64) | U(1)
BYTES = [np.random.default_rng(11 + k).integers(0, 2**64, 256, dtype=np.uint64) | U(1) for k in (0, 1)]


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK)

            def row(b: int) -> np.ndarray:
                x = np.full(size, b, U)
                x[0] = 1
                return np.multiply.accumulate(x)

            self.up, self.down = row(self.base), row(pow(self.base, -1, 2**64))
        return self.up[:n], self.down[:n]


POWERS = Powers(BASE)


def scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


MIX = np.random.default_rng(17).integers(0, 2**64, 8, dtype=np.uint64) | U(1)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; ``data`` ends with eight bytes more."""
    out = np.empty(len(data) - 8, U)
    for o in range(8):
        n = (len(data) - o) // 8
        part = data[o : o + 8 * n].view("<u8")
        out[o::8] = part[: len(out[o::8])]
    return out


def string_hash(eight: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the strings of ``size`` (at least 8) bytes from places on."""
    take = (lambda o: eight[o : len(eight) - size + 8 + o]) if isinstance(at, slice) else (lambda o: eight[at + o])
    places = [*range(0, size - 8, 8), size - 8]
    h = take(places[0]) * MIX[0]
    for k, o in enumerate(places[1:], 1):
        h = (h ^ (h >> U(29))) + take(o) * MIX[k]
    return scramble(h)


def sampled(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places of texts that stand one after another, and their first names.

    Of a window's ``width - CORE + 1`` cores the place is that of the smallest hash of its strings of ``short``
    bytes, modulo the number of cores: fewer places are sampled than by the smallest core.
    """
    none = np.zeros(0, np.int64)
    cores = width - CORE + 1
    if len(data) < width:
        return none, none.view(U)
    short = 4 + (CORE - 4) % cores
    short += cores if short < 8 else 0
    eight = loads(np.concatenate([data, np.zeros(8, np.uint8)]))
    h = string_hash(eight, slice(None), short)[: len(data) - short + 1]
    m, s, span = (h & ~LOW) | np.arange(len(h), dtype=np.uint64), 1, width - short + 1  # ties go to the first place
    while 2 * s <= span:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < span:
        m = np.minimum(m[: len(m) - (span - s)], m[span - s :])
    cross = np.zeros(len(m) + 1, np.int64)  # windows that reach from one text into the next
    for e in ends[:-1]:
        if e - width + 1 < len(m):
            cross[max(0, e - width + 1)] += 1
            cross[min(len(m), e)] -= 1
    start = np.flatnonzero(np.cumsum(cross[:-1]) == 0)
    hit = np.zeros(len(data), bool)
    hit[start + ((m[start] & LOW).astype(np.int64) - start) % cores] = True
    p = np.flatnonzero(hit)
    return p, string_hash(eight, p, CORE)


Batches = Iterator[pd.DataFrame]
Arrow = Iterator[pa.RecordBatch]


def documents(batches: Arrow, skip: bitmaps.Told | None) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Lists of (document ids, ends, bytes): about ``AT_ONCE`` documents, in chunks of about CHUNK bytes; a longer text
    is a chunk of its own. Documents that ``skip`` tells for certain are left out."""
    for batch in batches:
        if skip is not None:
            stay = skip.how(batch.column("x").to_numpy()) != 1
            batch = batch.filter(pa.array(stay))
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            ids, texts = part.column("doc_id").to_numpy(), part.column("text")
            sizes = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
            _, offsets, raw = sizes.buffers()
            off = np.frombuffer(offsets, np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            out, lo = [], 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
                hi = min(hi, len(ids))
                out.append((ids[lo:hi], off[lo + 1 : hi + 1] - off[lo], data[off[lo] : off[hi]]))
                lo = hi
            yield out


def _first_in_batch(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document, the start of each key in it, and whether a key has several documents."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    several = np.maximum.reduceat(d, start) != d[start] if len(k) else np.zeros(0, bool)
    return order, start, several


def _core_names(width: int, skip, ranges: int) -> Callable[[Arrow], Arrow]:
    """(range, names as 48 bits each): the first names of each batch; twice if the batch has them in several documents."""

    def run(batches: Arrow) -> Arrow:
        for chunk in documents(batches, skip and skip.value):
            h, doc = [], []
            for ids, ends, data in chunk:
                p, own = sampled(data, ends, width)
                h.append(own)
                doc.append(ids[np.searchsorted(ends, p, side="right")])
            h, doc = np.concatenate(h), np.concatenate(doc)
            order, start, several = _first_in_batch(h, doc)
            own = h[order][start]
            own = np.sort(np.concatenate([own, own[several]]))
            cut = np.searchsorted((own >> U(32)) * U(ranges) >> U(32), np.arange(ranges + 1, dtype=np.uint64))
            raw = np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([raw[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], names=["range", "names"])

    return run


def _shared_names(part: pd.DataFrame) -> pd.DataFrame:
    """The names of one range that occur twice."""
    raw = np.frombuffer(b"".join(part["names"]), np.uint8).reshape(-1, 6)
    h = np.zeros((len(raw), 8), np.uint8)
    h[:, :6] = raw
    h = np.sort(h.view("<u8").ravel())
    again = h[1:][h[1:] == h[:-1]]
    return pd.DataFrame({"h": np.unique(again).astype(np.int64)})


def _contexts(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, width: int, names: bitmaps.Bitmap):
    """What has a first name that the bitmap holds: (h, ctx, chk, doc, pos, left, right, bytes); bytes beyond the text are 0."""
    p, h = sampled(data, ends, width)
    keep = names.has(h)
    p, h = p[keep], h[keep]
    which = np.searchsorted(ends, p, side="right")
    first = np.concatenate([[0], ends])[which]
    side = width - CORE
    left, right = np.minimum(side, p - first), np.minimum(side, ends[which] - p - CORE)
    padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side, np.uint8)])
    column = np.arange(2 * side + CORE)
    raw = padded[p[:, None] + column]
    raw[(column < side - left[:, None]) | (column >= side + CORE + right[:, None])] = 0
    edge = scramble((left * 64 + right).astype(U))
    ctx, chk = np.empty(len(p), U), np.empty(len(p), U)
    for at in range(0, len(p), 1 << 14):
        part = slice(at, at + (1 << 14))
        for k, out in ((0, ctx), (1, chk)):
            out[part] = scramble((BYTES[k][raw[part]] * CONTEXT[k][: len(column)]).sum(axis=1, dtype=U) + edge[part])
    return h.view(np.int64), ctx.view(np.int64), (chk >> U(33)).astype(np.int64), ids[which], p - first, left, right, raw


PLACES = "h long, ctx long, chk long, doc long, place long"


def _places(width: int, skip, names) -> Callable[[Arrow], Arrow]:
    """PLACES with a first name that several documents have; place packs position and reach."""

    def run(batches: Arrow) -> Arrow:
        for chunk in documents(batches, skip and skip.value):
            h, ctx, chk, doc, pos, left, right = (np.concatenate(x) for x in list(zip(*(_contexts(*c, width, names.value) for c in chunk), strict=True))[:7])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (h, ctx, chk, doc, pos << 12 | left << 6 | right)], names=["h", "ctx", "chk", "doc", "place"])

    return run


def _open_places(width: int, skip, names, contexts) -> Callable[[Arrow], Arrow]:
    """(ctx, chk, doc, place, bytes) of the contexts that may have to be merged, of a batch's smallest document with each."""

    def run(batches: Arrow) -> Arrow:
        for chunk in documents(batches, skip and skip.value):
            parts, raw = [], []
            for ids, ends, data in chunk:
                own = _contexts(ids, ends, data, width, names.value)
                at = np.flatnonzero(contexts.value.has(own[1]))
                parts.append([c[at] for c in own[1:7]])
                raw.append(own[7][at])
            ctx, chk, doc, pos, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
            raw = np.concatenate(raw)
            order, start, _ = _first_in_batch(ctx, doc)
            least = np.repeat(doc[order][start], np.diff(np.append(start, len(order))))
            i = np.sort(order[doc[order] == least])
            place = pos << 12 | left << 6 | right
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[i].astype(np.int64)) for c in (ctx, chk, doc, place)] + [pa.array([r.tobytes() for r in raw[i]], pa.binary())], names=["ctx", "chk", "doc", "place", "bytes"]
            )

    return run


def _window_hashes(raw: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(a, hash of the window that starts a bytes before the core) for each a."""
    side = width - CORE
    m = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), 2 * side + CORE)
    up, down = POWERS(m.shape[1] + 1)
    sums = np.zeros((len(raw), m.shape[1] + 1), U)
    np.cumsum(BYTES[0][m] * down[: m.shape[1]], axis=1, out=sums[:, 1:])
    for a in range(side + 1):
        s = side - a
        yield a, scramble((sums[:, s + width] - sums[:, s]) * up[s])


SPANS = "doc long, start long, stop long"


def _merge_windows(width: int) -> Callable[[Batches], Batches]:
    """Rows sorted by first name -> spans that a smaller document has, by comparing equal windows."""
    side = width - CORE

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        h, doc, pos, left, right = (part[c].to_numpy() for c in ("h", "doc", "pos", "left", "right"))
        group = scramble(h.view(U))
        lo, hi = np.full(len(h), side + 1), np.full(len(h), -1)
        for a, key in _window_hashes(part["bytes"].tolist(), width):
            ok = np.flatnonzero((left >= a) & (right >= side - a))
            k, d = scramble(key[ok] + group[ok]), doc[ok]
            order, start, several = _first_in_batch(k.view(np.int64), d)
            least = np.repeat(d[order][start], np.diff(np.append(start, len(order))))
            hit = ok[order[d[order] > least]]
            lo[hit], hi[hit] = np.minimum(lo[hit], a), np.maximum(hi[hit], a)
        hit = hi >= 0
        return pd.DataFrame({"doc": doc[hit], "start": pos[hit] - hi[hit], "stop": pos[hit] - lo[hit] + width})

    def run(batches: Batches) -> Batches:
        held: list[pd.DataFrame] = []
        for batch in batches:
            last = batch["h"].iloc[-1] if len(batch) else None
            whole = batch[batch["h"] != last] if len(batch) else batch
            held_same = bool(held) and len(batch) and held[0]["h"].iloc[0] == last
            if len(whole) or not held_same:
                ready = pd.concat([*held, whole]) if held else whole
                if len(ready):
                    yield solve(ready)
                held = []
            if len(batch):
                held.append(batch[batch["h"] == last])
        if held:
            yield solve(pd.concat(held))

    return run


def _spread_windows(width: int) -> Callable[[Batches], Batches]:
    """(h, key, doc, start): the windows of a hot half's contexts."""
    side = width - CORE
    half = -(-side // 2)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                h, doc, pos, left, right, on_left = (part[c].to_numpy() for c in ("h", "doc", "pos", "left", "right", "on_left"))
                for a, key in _window_hashes(part["bytes"].tolist(), width):
                    ok = (left >= a) & (right >= side - a) & (on_left == (a >= half))
                    yield pd.DataFrame({"h": h[ok], "key": key[ok].view(np.int64), "doc": doc[ok], "start": pos[ok] - a})

    return run


def halves(opened: DataFrame, width: int) -> DataFrame:
    """Contexts of hot first names, each with the half of a window's other bytes on the left of the core and with that on the right: h names
    core and half, n_ctx how many rows have them. A window that starts at least half before the core has the left half whole, any
    other the right one. Halves of one document are dropped."""
    side = width - CORE
    half = -(-side // 2)
    beside = F.when(F.col("on_left"), F.substring("bytes", side - half + 1, half)).otherwise(F.substring("bytes", side + CORE + 1, half))
    reach = F.when(F.col("on_left"), F.col("left")).otherwise(F.col("right"))
    both = opened.withColumn("on_left", F.explode(F.array(F.lit(True), F.lit(False)))).where(reach >= half)
    both = both.withColumn("h", F.xxhash64("h", "on_left", beside)).drop("n_ctx")
    sizes = both.groupBy("h").agg(F.count(F.lit(1)).alias("n_ctx"), F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return both.join(sizes.select("h", "n_ctx"), "h")


def copies(own: DataFrame) -> DataFrame:
    """(doc, n): documents whose whole text a document with a smaller id has, too."""
    named = own.select("doc_id", F.sha2("text", 256).alias("name"), F.octet_length("text").alias("n"))
    least = named.groupBy("name", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return named.join(least, ["name", "n"]).where("doc_id > least").select(F.col("doc_id").alias("doc"), "n")


def repeated_spans(own: DataFrame, gone: DataFrame | None, width: int = WIDTH) -> DataFrame:
    """(doc, start, stop): bytes of ``width``-byte strings that start in a document with a smaller id.

    ``own``: doc_id and text, as bytes, of at least ``width`` bytes. ``gone``: ids (id) of copies, which are left out as
    far as bitmaps tell. Spans may overlap or touch; rows that repeat an id count as one document. ``width`` is from
    CORE + 4 to CORE + 63.
    """
    if not 4 <= width - CORE < 64:
        raise ValueError(f"width must be from {CORE + 4} to {CORE + 63}")
    skip = bitmaps.told(own, gone) if gone is not None else None
    own = own.select("doc_id", F.xxhash64("doc_id").alias("x"), "text")
    ranges = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    first = own.mapInArrow(_core_names(width, skip, ranges), "range int, names binary")
    first = materialize(first.groupBy("range").applyInPandas(_shared_names, "h long"), "first-names")
    names = bitmaps.shared(first, "h", first.count())
    forget(first)
    places = materialize(own.mapInArrow(_places(width, skip, names), PLACES), "places")
    second = materialize(places.groupBy("ctx", "chk").agg(F.min("doc").alias("least"), F.first("h").alias("h")), "second-names")
    reach = F.shiftright("place", 6).bitwiseAND(F.lit(63)), F.col("place").bitwiseAND(F.lit(63))
    pos = F.shiftright("place", 12)
    again = places.select("ctx", "chk", "doc", "place").join(second.select("ctx", "chk", "least"), ["ctx", "chk"]).where("doc > least")
    again = again.select("doc", (pos - reach[0]).alias("start"), (pos + reach[1] + CORE).alias("stop"))
    several = second.groupBy("h").agg(F.count(F.lit(1)).alias("n_ctx")).where("n_ctx > 1")
    several = materialize(second.join(several, "h"), "open-names")
    contexts = bitmaps.shared(several, "ctx", several.count())
    opened = own.mapInArrow(_open_places(width, skip, names, contexts), "ctx long, chk long, doc long, place long, bytes binary")
    opened = opened.join(several.hint("merge"), ["ctx", "chk"]).where("doc = least")
    opened = materialize(opened.select("h", "n_ctx", "doc", pos.alias("pos"), reach[0].alias("left"), reach[1].alias("right"), "bytes"), "open-places")
    parted = materialize(halves(opened.where(F.col("n_ctx") > HOT_CONTEXTS), width), "halves")
    merged = ("h", "doc", "pos", "left", "right", "bytes")
    few = opened.where(F.col("n_ctx") <= HOT_CONTEXTS).select(*merged).unionByName(parted.where(F.col("n_ctx") <= HOT_CONTEXTS).select(*merged)).repartition("h").sortWithinPartitions("h").mapInPandas(_merge_windows(width), SPANS)
    many = parted.where(F.col("n_ctx") > HOT_CONTEXTS).select(*merged, "on_left").repartition(F.xxhash64("doc", "pos"))
    many = materialize(many.mapInPandas(_spread_windows(width), "h long, key long, doc long, start long"), "windows")
    shared = many.groupBy("h", "key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    many = many.join(shared, ["h", "key"]).where("doc > least").select("doc", "start", (F.col("start") + width).alias("stop"))
    return again.unionByName(few).unionByName(many)


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc, spans): maximal disjoint runs of each document, in order; touching ones are one."""
    listed = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("raw"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    first = F.struct(none.alias("out"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"))
    done = lambda a: F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop"))))
    merge = F.aggregate(
        "raw",
        first,
        lambda a, s: F.when(a["stop"].isNull(), F.struct(none.alias("out"), s["start"].alias("start"), s["stop"].alias("stop")))
        .when(s["start"] <= a["stop"], F.struct(a["out"].alias("out"), a["start"].alias("start"), F.greatest(a["stop"], s["stop"]).alias("stop")))
        .otherwise(F.struct(done(a).alias("out"), s["start"].alias("start"), s["stop"].alias("stop"))),
        done,
    )
    return listed.select("doc", merge.alias("spans"))


def _cut(digest: bool) -> Callable[[Arrow], Arrow]:
    """Texts with their spans -> what is left of them."""

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            gone, kept = [], []
            for raw, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                at, parts = 0, []
                for s in spans or ():
                    parts.append(raw[at : s["start"]])
                    at = s["stop"]
                gone.append(sum(s["stop"] - s["start"] for s in spans or ()))
                kept.append(b"".join([*parts, raw[at:]]))
            if digest:
                kept = [hashlib.sha256(k).hexdigest() for k in kept]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(gone, pa.int64()), batch.column("n_spans"), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the remaining bytes
    (``kept``, or with ``digest`` their SHA-256 as kept_sha256).

    Null and empty texts, texts shorter than ``width`` and rows without an id lose nothing. Of rows with one id each is
    cut alike only if its text is the same: ids are meant to be unique. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    own = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    whole = materialize(copies(own), "copies")
    gone = whole.select(F.col("doc").alias("id"))
    spans = materialize(merged_spans(repeated_spans(own, gone, width)), "spans")
    content = F.sha2("text", 256).alias("kept_sha256") if digest else F.col("text").alias("kept")
    nothing = F.sha2(F.lit(b""), 256).alias("kept_sha256") if digest else F.lit(b"").alias("kept")
    zero = F.lit(0).cast("long")
    # copies need no text; of the others only texts that may lose something move, the rest is finished where it is read
    size = F.octet_length("text").cast("long").alias("n_bytes")
    ids = own.select("doc_id", size).join(whole.distinct(), F.col("doc_id") == F.col("doc"), "left_semi")
    ids = ids.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing)
    may = bitmaps.shared(spans.select(F.xxhash64("doc").alias("x")), "x", spans.count())

    @F.pandas_udf("boolean")
    def may_lose(x: pd.Series) -> pd.Series:
        return pd.Series(may.value.has(x.to_numpy()))

    rest = bitmaps.without(rows, gone)
    flagged = rest.withColumn("may", may_lose(F.xxhash64("doc_id")))
    still = flagged.where("not may").select("doc_id", size, zero.alias("n_removed"), zero.alias("n_spans"), content)
    moved = flagged.where("may").join(spans.hint("merge"), F.col("doc_id") == F.col("doc"), "left").withColumn("spans", F.when(F.octet_length("text") >= width, F.col("spans")))
    moved = moved.select("doc_id", size, F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return ids.unionByName(still).unionByName(moved.mapInArrow(_cut(digest), schema))
