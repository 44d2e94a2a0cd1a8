"""Best-fit packing of token sequences by hierarchical residual packing.

Texts become token pieces of at most ``capacity`` ids. Every partition packs its pieces best-fit
(longest first) and emits the bins that are nearly full. All other bins climb a tree: each node takes the
underfull bins of its children as items, packs them best-fit and emits what has become nearly full. Bins that
are more than half full never fit together, so what is left at the root is opened: in further rounds the
pieces are dealt by hash over nodes of bounded size and packed again, until one node is left or a round saves
next to nothing. No task grows with the input and no piece is dropped.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_texts, materialize, text_or_empty

CAPACITY = 2048
#: A bin with at most this many free places is nearly full, by round; later rounds are less choosy.
SLACK = (8, 16, 32, 64)
CARRY = 4096
FAN_IN = 8
LEAST_GAIN = 0.001
CACHE = 400_000
#: Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Cache(dict):
    """Values by key, made on demand; of two generations of ``limit`` keys the older one goes."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE never joins what lies on both sides of a single space or line end between
    two other characters. Texts are cut there, and the ids of the parts are kept in caches of
    bounded size. Texts with other white space are encoded as they are. Where the vocabulary numbers
    its merges in order, parts go through the same vocabulary as ranks, which is several times faster;
    texts that hold a special token always go through the tokenizer itself.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranked = ranks(spec)
        self.fast = None
        if ranked:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranked, special_tokens={}).encode_ordinary
        self.plain = Cache(self.part, cache // 4)
        self.spaced = Cache(lambda w: self.part(" " + w), cache)
        self.line_end = self.part("\n")

    def part(self, text: str) -> bytes:
        return array("I", self.fast(text) if self.fast else self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.whole(text)
        words = text.split()
        between = len(words) - 1
        if between < 1 or len(text) != sum(map(len, words)) + between or text.count(" ") + text.count("\n") != between:
            return self.part(text)
        out, spaced = [], self.spaced.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.plain[first])
            out += map(spaced, rest)
            out.append(self.line_end)
        out.pop()
        return b"".join(out)


def ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if it is a plain byte-level BPE whose ids follow its merges."""
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    # byte-level vocabularies write bytes as printable characters: those that are printable stand for themselves
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = spec["model"]["vocab"]
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
    if None in made or made != sorted(made):
        return None
    return {bytes(chars[c] for c in t): i for t, i in vocabulary.items() if t not in special}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of several, the first holds what is left over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, min(capacity, first if s == 0 and first else capacity)) for s in starts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, on request, ids.

    A document is its text's ids and then id 0, so even a null or empty text has one token.
    """
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def begin() -> Callable[[list[str]], dict]:
        encode = Encoder(tokenizer)

        def make(texts: list[str]) -> dict:
            out = []
            for text in texts:
                blob = encode(text) + b"\0\0\0\0"
                own = []
                for k, (start, n) in enumerate(cut(len(blob) // 4, capacity)):
                    raw = blob[4 * start : 4 * (start + n)]
                    own.append({"piece": k, "start": start, "length": n, "ids_crc32": zlib.crc32(raw)} | ({"ids": np.frombuffer(raw, "<u4").astype("int64")} if ids else {}))
                out.append(own)
            return {"pieces": out}

        return make

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_texts(own, f"pieces array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>", begin, at_once=256).select("doc_id", F.inline("pieces"))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit by falling size: each item goes to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free places, bin), sorted
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        k = bisect_left(free, (n, -1))
        if k == len(free):
            bins.append([int(i)])
            left, b = capacity - n, len(bins) - 1
        else:
            left, b = free.pop(k)
            left -= n
            bins[b].append(int(i))
        if left:
            insort(free, (left, b))
    return bins


BIN = "closed boolean, node long, rows array<long>, lengths array<long>, offsets array<long>"


def _bins(sizes: np.ndarray, rows: list[np.ndarray], lengths: list[np.ndarray], node: int, capacity: int, slack: int) -> pd.DataFrame:
    """Items of these sizes, each a run of rows with their lengths, as best-fit bins of a node; nearly full ones are closed."""
    out = []
    for b in best_fit(sizes, capacity):
        n = np.concatenate([lengths[i] for i in b])
        out.append((bool(n.sum() >= capacity - slack), node, np.concatenate([rows[i] for i in b]), n, np.cumsum(n) - n))
    return pd.DataFrame(out, columns=["closed", "node", "rows", "lengths", "offsets"])


def _pack(part: pd.DataFrame, node: int, capacity: int, slack: int) -> pd.DataFrame:
    """Bins of single pieces."""
    rows, sizes = part["row"].to_numpy(), part["length"].to_numpy()
    each = np.arange(len(sizes) + 1)
    return _bins(sizes, [rows[a : a + 1] for a in each], [sizes[a : a + 1] for a in each], node, capacity, slack)


def merge_tree(bins: DataFrame, capacity: int, slack: int, load: int, fan_in: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of closed bins, the bins that are still open at the root): up a tree of ``fan_in`` over the nodes, the open bins of a node's children are
    items of one best-fit round. A node with more than ``load`` of them is several, dealt by hash, so no task grows with the input."""

    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lengths = list(part["lengths"])
        return _bins(np.array([n.sum() for n in lengths]), list(part["rows"]), lengths, int(key[0]), capacity, slack)

    every = []
    while True:
        every.append(bins.where("closed"))
        rest = bins.where("not closed")
        up = rest.withColumn("node", F.floor(F.col("node") / fan_in))
        top, most = rest.groupBy("node").agg(F.count(F.lit(1)).alias("n")).groupBy(F.floor(F.col("node") / fan_in)).agg(F.max("node").alias("top"), F.sum("n").alias("n")).agg(F.max("top"), F.max("n")).first()
        if not top:  # one node, or no open bin
            return every, rest
        salt = F.pmod(F.xxhash64(F.col("rows")[0]), F.lit(-(-most // load)))
        bins = materialize(up.groupBy("node", salt.alias("salt")).applyInPandas(merged, BIN), "bins")


def pack(items: DataFrame, capacity: int = CAPACITY, slack: tuple[int, ...] = SLACK, carry: int = CARRY, fan_in: int = FAN_IN) -> DataFrame:
    """(row, length) -> (row, sequence_id, offset): a place for every row.

    Rows are numbers that occur once, lengths are from 1 to ``capacity``. Partitions pack best-fit, open bins are merged as items up
    a tree (``merge_tree``). What is open at its root can't be merged any further and is opened: in rounds its pieces are dealt by hash over nodes of about
    ``carry * fan_in`` pieces, so that each node meets all sizes. Rounds end with a single node, or when one saves less than ``LEAST_GAIN`` of
    the bins. An empty table gives an empty result.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _pack(batch, TaskContext.get().partitionId(), capacity, slack[0])

    def opened(room: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def packs(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return _pack(part, int(key[0]), capacity, room)

        return packs

    load = carry * fan_in
    every, rest = merge_tree(materialize(items.select("row", "length").mapInPandas(first, BIN), "bins"), capacity, slack[0], load, fan_in)
    level = 0
    while True:
        n_open, n_pieces = rest.agg(F.count(F.lit(1)), F.sum(F.size("rows"))).first()
        if not n_open or level and (nodes == 1 or not gained):
            break
        level, nodes, room = level + 1, -(-n_pieces // load), slack[min(level + 1, len(slack) - 1)]
        pieces = rest.select(F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("lengths").alias("length"))))
        pieces = pieces.withColumn("node", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(nodes)))
        bins = materialize(pieces.groupBy("node").applyInPandas(opened(room), BIN), "bins")
        merged = n_open - bins.count()
        gained = merged >= n_open * LEAST_GAIN
        if merged < 0:  # the round before was better
            break
        every.append(bins.where("closed"))
        rest = bins.where("not closed")
    every.append(rest)
    every = reduce(DataFrame.unionByName, every)
    # a sequence's number is its smallest row, which no other sequence has
    places = F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("offsets").alias("offset")))
    return every.select(F.array_min("rows").alias("sequence_id"), places)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``token_pieces`` with sequence_id and offset for each piece; ``ids`` keeps the tokens.

    Null and empty texts have one token. Rows that repeat a doc_id are packed each on their own.
    Columns besides id and text are not read. An empty table gives an empty result.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, id_col, text_col, ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity), "row").drop("row")
