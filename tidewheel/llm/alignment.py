"""Alignment of two tokenizers' tokens by diagonal run skipping.

Tokens of both tokenizers cover the same bytes, so a token is its end. Where ends agree at the current shift between
the two sequences (its diagonal), tokens stand one to one: blocks of doubled length of both end arrays are compared, then
halved, so a stretch costs its logarithm. Where they differ, the shorter side steps on until both
end together; that is an irregular group, and the shift after it is the new diagonal. Groups, links (token pairs whose bytes
overlap) and all that is counted of them come from this walk.

Texts are aligned once and written with their links; Spark sums the links of each pair of ids, and every document looks its pairs up.
The table of counts is sent to all tasks while it is below a checked size and joined beyond.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import forget, map_texts, materialize
from .packing import PATTERN, ranks

#: Rows of the table of counts up to which it is sent to every task (17 bytes each), and beyond which it is joined.
SENT_ROWS = 4_000_000
#: Stretches whose tokens a task holds, in each of two generations.
HELD = 300_000
SALTS = 32


class Pair:
    """Both tokenizers: ids of A as little-endian 16-bit or wider numbers, ids of B likewise, for stretches of texts.

    A stretch is a word with the single space or line end before it. Neither tokenizer joins what lies on both sides
    of such a place, so ids of stretches are ids of the text. Texts with other white space are one stretch. Where A's vocabulary
    numbers its merges in order it is read as ranks, which is several times faster; a test holds both against the tokenizers themselves.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        spec = json.loads(a.to_str())
        ranked = ranks(spec)
        if ranked:
            import tiktoken

            self.encode_a = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranked, special_tokens={}).encode_ordinary
            of_a = {i: len(t) for t, i in ranked.items()}
        else:
            self.encode_a = lambda t: a.encode(t, add_special_tokens=False).ids
            of_a = {i: len(t) for t, i in a.get_vocab().items()}  # a printable character for each byte
        self.size_a = max(a.get_vocab().values()) + 1
        self.length_a = np.zeros(self.size_a, "i4")
        self.length_a[list(of_a)] = list(of_a.values())
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_b = np.array([len(t) for t in self.bytes_b], "i4")
        self.size_b = len(pieces)
        self.lead = self.b.piece_to_id("▁")
        # A's pattern cuts at single spaces and line ends; B does if no piece has a line end, or a space but in front
        self.splits = bool(ranked) and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def stretches(self, text: str) -> list[str]:
        """The stretches of a space and the text."""
        words = text.split()
        between = len(words) - 1
        if not self.splits or between < 1 or "\0" in text or len(text) != sum(map(len, words)) + between or text.count(" ") + text.count("\n") != between:
            return [" " + text]
        return (" " + text.replace(" ", "\0 ").replace("\n", "\0\n")).split("\0")

    def learn(self, stretches: list[str]) -> None:
        """Keeps the tokens of stretches; none where their bytes are not those of the stretch."""
        known, old, bytes_b = self.known, self.old, self.bytes_b
        known.update((s, old[s]) for s in stretches if s in old)
        new = [s for s in stretches if s not in known]
        if not new:
            return
        all_b = self.b.encode([s[1:] if s[0] == " " else s for s in new], num_threads=1)
        all_b = [b if s[0] == " " else b[1:] if b[0] == self.lead else [] for s, b in zip(new, all_b, strict=True)]
        if self.splits and len(new) > 1:  # A takes them as one text; they stand for themselves in it
            raw = [s.encode() for s in new]
            ids = np.array(self.encode_a("".join(new)), "<u4")
            ends = np.searchsorted(np.cumsum(self.length_a[ids]), np.cumsum([len(r) for r in raw])) + 1
            blob, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            for k, (s, r, b) in enumerate(zip(new, raw, all_b, strict=True)):
                known[s] = (blob[at[k] : at[k + 1]], array("I", b).tobytes()) if b"".join([bytes_b[i] for i in b]) == r else None
            return
        for s, b in zip(new, all_b, strict=True):
            known[s] = (array("I", self.encode_a(s)).tobytes(), array("I", b).tobytes()) if b"".join([bytes_b[i] for i in b]) == s.encode() else None

    def tokens(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B for each text, in 32 bits; none for null or empty texts and where bytes differ."""
        cut = [self.stretches(t) if t else [] for t in texts]
        if len(self.known) > HELD:
            self.old, self.known = self.known, {}
        known = self.known
        self.learn(list(set().union(*(c for c in cut if len(c) > 1)).difference(known)))
        for c in cut:  # texts that are one stretch stand for themselves only when they stand alone
            if len(c) == 1 and c[0] not in known:
                self.learn(c)
        out: list[tuple[bytes, bytes] | None] = []
        for c in cut:
            parts = [known[s] for s in c]
            if not parts or None in parts:
                out.append(None)
            else:
                a, b = zip(*parts, strict=True)
                out.append((b"".join(a), b"".join(b)))
        return out


class Walk:
    """The walk over two arrays of ends, as parts (i, j, n): n one-to-one tokens from i in A and from j in B, then
    one irregular group up to the next part, unless both arrays end."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        self.ends_a, self.ends_b, self.n_a, self.n_b = ends_a, ends_b, len(ends_a), len(ends_b)
        if self.n_a and ends_a[-1] != ends_b[-1]:
            raise ValueError("both sides must cover the same bytes")
        parts: list[int] = []
        # what stands behind the last ends differs, so no probe passes them
        a, b = [*ends_a.tolist(), -1], [*ends_b.tolist(), -2]
        i = j = 0
        while i < self.n_a:
            n = 0
            if a[i] == b[j]:
                n = 1
                if a[i + 1] == b[j + 1]:
                    n = step = 2
                    while a[i + n : i + n + step] == b[j + n : j + n + step]:
                        n += step
                        step += step
                    while step > 2:
                        step >>= 1
                        if a[i + n : i + n + step] == b[j + n : j + n + step]:
                            n += step
                    if a[i + n] == b[j + n]:
                        n += 1
            parts += (i, j, n)
            i += n
            j += n
            at_a, at_b = a[i], b[j]
            if at_a < 0:
                break
            while at_a != at_b:
                if at_a < at_b:
                    i += 1
                    at_a = a[i]
                else:
                    j += 1
                    at_b = b[j]
            i += 1
            j += 1
        self.i, self.j, self.n = np.array(parts, "i8").reshape(-1, 3).T
        #: Where the parts' irregular groups end; of the last part this may be its stretch's end.
        self.next_i, self.next_j = np.append(self.i[1:], self.n_a), np.append(self.j[1:], self.n_b)
        self.irregular = self.next_i > self.i + self.n

    def _stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each one-to-one token its part and its number in the part."""
        return np.repeat(np.arange(len(self.n)), self.n), np.arange(self.n.sum()) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the tokens of A and of B that are the last of their group."""
        part, step = self._stretches()
        last_a, last_b = np.zeros(self.n_a, "i8"), np.zeros(self.n_b, "i8")
        last_a[self.i[part] + step] = 1
        last_b[self.j[part] + step] = 1
        last_a[self.next_i[self.irregular] - 1] = 1
        last_b[self.next_j[self.irregular] - 1] = 1
        return last_a, last_b

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in A and in B of all linked tokens: those of stretches, then, in irregular groups, each token beside the
        one of the other side in which it ends; the group's last pair counts once."""
        part, step = self._stretches()
        start_a, start_b = (self.i + self.n)[self.irregular], (self.j + self.n)[self.irregular]
        n, m = self.next_i[self.irregular] - start_a, self.next_j[self.irregular] - start_b - 1
        in_a = np.repeat(start_a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        in_b = np.repeat(start_b, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        return (
            np.concatenate([self.i[part] + step, in_a, np.searchsorted(self.ends_a, self.ends_b[in_b])]),
            np.concatenate([self.j[part] + step, np.searchsorted(self.ends_b, self.ends_a[in_a]), in_b]),
        )


class Names:
    """Writes groups as ``a1,a2|b1;a3|b2,b3;``: decimal ids, each with the sign behind it, are rows of one table."""

    def __init__(self, size_a: int, size_b: int):
        self.size_a = size_a
        names = [b"%d%s" % (i, end) for size, ends in ((size_a, (b",", b"|")), (size_b, (b",", b";"))) for i in range(size) for end in ends]
        width = max(map(len, names))
        self.names = np.frombuffer(b"".join(t.rjust(width, b"\0") for t in names), "u1").reshape(-1, width)
        self.widths = np.array([len(t) for t in names], "i8")

    def __call__(self, walk: Walk, a: np.ndarray, b: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, bytes, list[int]]:
        """Marks of A's last tokens of groups, all groups, and where the first ``tokens`` tokens of both sides end in that, for each number."""
        last_a, last_b = walk.groups()
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # a token of A stands behind B's tokens of earlier groups, one of B behind A's tokens up to its own group
        before = np.concatenate([[0], np.flatnonzero(last_b) + 1])
        order = np.empty(walk.n_a + walk.n_b, "i8")
        order[np.arange(walk.n_a) + before[group_a]] = 2 * a + last_a
        order[np.arange(walk.n_b) + np.flatnonzero(last_a)[group_b] + 1] = 2 * (self.size_a + b) + last_b
        rows = self.names[order]
        shown = rows != 0
        ends = np.cumsum(self.widths[order])[tokens - 1]
        return last_a, rows[shown].tobytes(), ends.tolist()


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _begin(path_a: str, path_b: str) -> Callable[[list[str | None]], dict]:
    """A task's function from texts to the columns of ``FIELDS``. ``links``: the sorted pairs (A's id times the size of B plus
    B's id) of all links, each as its distance from the one before, in 32 bits."""
    pair = Pair(path_a, path_b)
    names, nothing = Names(pair.size_a, pair.size_b), (0, 0, 0, 0, "", b"")

    def make(texts: list[str | None]) -> dict:
        ids = pair.tokens(texts)
        some = [x for x in ids if x]
        rows: list[tuple] = []
        if some:
            # a text ends with a token of both sides, so all texts are one walk and come apart again at their ends
            a, b = (np.frombuffer(b"".join(x), "<u4").astype("i8") for x in zip(*some, strict=True))
            n_a, n_b = (np.array([len(x) // 4 for x in side]) for side in zip(*some, strict=True))
            walk = Walk(np.cumsum(pair.length_a[a], dtype="i8"), np.cumsum(pair.length_b[b], dtype="i8"))
            at_a, at_b = walk.links()
            text = np.searchsorted(np.cumsum(n_a), at_a, side="right")
            order = np.lexsort((a[at_a] * pair.size_b + b[at_b], text))
            pairs, n_links = (a[at_a] * pair.size_b + b[at_b])[order], np.bincount(text, minlength=len(some))
            last_a, said, ends = names(walk, a, b, np.cumsum(n_a) + np.cumsum(n_b))
            n_groups = np.diff(np.cumsum(last_a)[np.cumsum(n_a) - 1], prepend=0)
            starts = np.cumsum(n_links) - n_links
            for k in range(len(some)):
                own = said[ends[k - 1] if k else 0 : ends[k] - 1]
                gaps = np.diff(pairs[starts[k] : starts[k] + n_links[k]], prepend=0).astype("<u4").tobytes()
                rows.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(own).hexdigest(), gaps))
        found = iter(rows)
        rows = [next(found) if x else nothing for x in ids]
        return dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"), map(list, zip(*rows, strict=True)), strict=True))

    return make


def _pairs(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u4"), dtype="i8")


def _uniques(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of batches of links."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            pairs, n = np.unique(np.concatenate([_pairs(b) for b in batch.column(0).slice(at, 2000).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype("i8"))], names=["pair", "n"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pair, times): each document's distinct pairs."""
    for batch in batches:
        for row, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, n = np.unique(_pairs(blob), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(n.astype("i8"))], names=["row", "pair", "times"])


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best) over all links: how many there are of a pair of ids, and whether no other pair with its id of B has more."""
    summed = found.select("links").mapInArrow(_uniques, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.col("pair") % size_b)))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", sent_rows: int = SENT_ROWS) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text (before which it puts a space), both without special tokens. Texts that are null, empty, or
    whose tokens' bytes are not those of the space and the text have no tokens: zeros and an empty string. ``n_best`` counts the links
    whose pair no other pair with the same id of B exceeds in all texts, ``count_sum`` sums the pairs' counts over the links. Rows that repeat an
    id are documents each on their own; a null id is kept. An empty table gives an empty result. Other columns are not read.

    ``sent_rows``: see ``SENT_ROWS``; results are the same on both sides of it.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = map_texts(own, FIELDS, partial(_begin, path_a, path_b), at_once=200).withColumn("row", F.monotonically_increasing_id())
    found = materialize(found, "aligned", compression="zstd")
    counts = materialize(pair_counts(found, size_b), "pairs")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= sent_rows:
        got = counts.toArrow().sort_by("pair")
        forget(counts)
        sent = docs.sparkSession.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("pair", "n", "best")))

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, n, best = sent.value
            for batch in batches:
                blobs = batch.column("links").to_pylist()
                at = [np.searchsorted(pairs, _pairs(b)) for b in blobs]
                added = [pa.array([int(best[x].sum()) for x in at], "int64"), pa.array([int(n[x].sum()) for x in at], "int64")]
                rest = batch.drop_columns(["links", "row"])
                yield pa.RecordBatch.from_arrays([*rest.columns, *added], names=[*rest.schema.names, "n_best", "count_sum"])

        schema = "doc_id long, " + FIELDS.replace(", links binary", "") + ", n_best long, count_sum long"
        return found.mapInArrow(looked_up, schema).select(*names)
    # a pair that many documents hold is met in one of several parts of its own
    held = found.select("row", "links").mapInArrow(_listed, "row long, pair long, times long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    dealt = counts.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    sums = held.join(dealt, ["pair", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return found.drop("links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(*names)
