"""Language of texts by a linear-chain CRF that labels every word.

Features of a word: its affixes, character trigrams and the word itself (a hashed lexicon), and
nothing else of the document. Transitions are learned on sequences that switch between
languages. A text's language is the label with the largest expected number of words by
forward-backward, and its score that label's mean probability.

The CRF is fitted on the driver from at most ``sample_docs`` labelled rows: stretches of words are drawn from
anywhere in their whole texts, inside tasks. That bound holds for the fit alone. Prediction reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf as C
from .base import fold, hashed_sample, map_texts, text_or_empty
from .near_dedup import mix

SAMPLE_DOCS = 3000
BUCKETS = 1 << 16
#: Stretches drawn from each text of the sample, and the most words of one.
PER_TEXT, STRETCH = 2, 12
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
STRIP = re.compile(r"^[\W\d_]+|[\W\d_]+$")
WORDS_AT_ONCE = 400_000
CACHE = 200_000


U = np.uint64


def _hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Feature numbers from code points; 0 stands for a code point that isn't there."""
    h = np.full(parts[0].shape, U(kind + 1))
    for x in parts:
        h = mix(h * U(0x9E3779B97F4A7C15) + x)
    return (h % U(BUCKETS - 1)).astype(np.int64) + 1


def feature_rows(words: list[str]) -> C.Features:
    """Of each word in lower case, without what isn't a letter at its ends: the word itself, its first and last two and three
    letters, and its trigrams with both ends marked. A word without letters has no features."""
    cores = [STRIP.sub("", w.lower()) for w in words]
    n = np.fromiter(map(len, cores), np.int64, len(cores))
    cp = np.frombuffer("".join(f"<{w}>" for w in cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    size = n + 2
    start = np.cumsum(size) - size
    counts = np.where(n > 0, n + 5, 1)
    base = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.int64)
    own = np.flatnonzero(n > 0)
    if not len(own):
        return flat, counts
    head, tail, m, none = start[own] + 1, start[own] + n[own], n[own], U(0)
    within = np.arange(len(cp)) - np.repeat(start, size)
    whole = np.add.reduceat(mix(cp + within.astype(U) * U(0xD6E8FEB86659FD93)), start)[own]
    first, last = [np.where(m > k, cp[np.minimum(head + k, len(cp) - 1)], none) for k in range(3)], [np.where(m > k, cp[tail - k], none) for k in range(3)]
    for k, f in enumerate((_hashed(0, whole), _hashed(1, *first[:2]), _hashed(2, *first), _hashed(3, *last[:2]), _hashed(4, *last))):
        flat[base[own] + k] = f
    at = np.flatnonzero(within < np.repeat(n, size))
    word = np.repeat(np.arange(len(words)), n)
    flat[base[word] + 5 + within[at]] = _hashed(5, cp[at], cp[at + 1], cp[at + 2])
    return flat, counts


def _stretches(seed: int) -> Callable[[], Callable[[list[str]], dict]]:
    """Of each text with letters ``PER_TEXT`` stretches of its words, the same on every run."""

    def make(texts: list[str]) -> dict:
        out = []
        for text in texts:
            rng = np.random.default_rng([seed, zlib.crc32(text.encode("utf-8", "surrogatepass"))])
            w, own = text.split(), []
            for _ in range(PER_TEXT if LETTER.search(text) else 0):
                at = int(rng.integers(0, max(1, len(w) - STRETCH)))
                own.append(w[at : at + int(rng.integers(4, STRETCH + 1))])
            out.append(own)
        return {"stretches": out}

    return lambda: make


def training_sequences(pools: list[tuple[list[str], int]], seed: int):
    """``pools``: stretches of words with their label. Sequences of one to three of them: words switch languages."""
    rng = np.random.default_rng(seed)
    by_label = [[i for i, p in enumerate(pools) if p[1] == k] for k in sorted({k for _, k in pools})]
    features, gold = [], []
    for _ in range(len(pools) // 2):
        words, y = [], []
        for _ in range(int(rng.integers(1, 4))):
            b = by_label[rng.integers(len(by_label))]
            w, k = pools[b[rng.integers(len(b))]]
            words += w
            y += [k] * len(w)
        features.append(feature_rows(words))
        gold.append(np.array(y))
    return features, gold


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> C.Crf:
    """``labelled``: rows with text and language. The sample is the same on every run."""
    own = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = map_texts(hashed_sample(own, sample_docs, "id", seed, "lang", "text"), "stretches array<array<string>>", _stretches(seed)).collect()
    labels = sorted({r["lang"] for r in rows})
    pools = sorted((w, labels.index(r["lang"])) for r in rows for w in r["stretches"])
    if not pools:
        return C.Crf([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    features, gold = training_sequences(pools, seed)
    return C.train(labels, BUCKETS, features, gold, epochs=3, batch=64, rate=0.3, l2=0.0, seed=seed)


class Labeller:
    """Word label probabilities of texts; words' scores are kept in a cache of bounded size."""

    def __init__(self, model: C.Crf):
        self.model, self.known, self.scores = model, {}, np.zeros((CACHE, len(model.labels)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(set(words))
            if len(new) > CACHE:
                return self.model.emissions(feature_rows(words))
        if new:
            at = len(self.known)
            self.scores[at : at + len(new)] = self.model.emissions(feature_rows(new))
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def probabilities(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """For each list of words an array (words, labels)."""
        lengths = np.array([len(t) for t in texts])
        p = C.forward_backward(self.model, self.emissions([w for t in texts for w in t]), lengths)
        ends = np.cumsum(lengths)
        for n, e in zip(lengths, ends, strict=True):
            yield p[e - n : e]


LABELS = "lang_pred string, score double, certainty double, n_switches long"


def _predict(shared) -> Callable[[], Callable[[list[str]], dict]]:
    def some(labeller: Labeller, texts: list[str]) -> Iterator[tuple]:
        labels = labeller.model.labels
        for p in labeller.probabilities([t.split() for t in texts]):
            mean = p.mean(axis=0, dtype=np.float64)
            best = int(mean.argmax())
            certainty = p.max(axis=1).mean(dtype=np.float64)
            yield labels[best], float(min(1.0, max(0.0, mean[best]))), float(min(1.0, certainty)), int((np.diff(p.argmax(axis=1)) != 0).sum())

    def start() -> Callable[[list[str]], dict]:
        labeller = Labeller(shared.value)

        def make(texts: list[str]) -> dict:
            rows = [(UNKNOWN, 0.0, 0.0, 0)] * len(texts)
            todo = [k for k, t in enumerate(texts) if LETTER.search(t)] if labeller.model.labels else []
            todo.sort(key=lambda k: -len(texts[k]))  # texts of about one length together
            size, at = np.cumsum([len(texts[k]) // 6 + 1 for k in todo]), 0
            while at < len(todo):
                n = max(1, int(np.searchsorted(size, WORDS_AT_ONCE + (size[at - 1] if at else 0))) - at)
                pick = todo[at : at + n]
                for k, row in zip(pick, some(labeller, [texts[k] for k in pick]), strict=True):
                    rows[k] = row
                at += n
            return dict(zip(("lang_pred", "score", "certainty", "n_switches"), zip(*rows, strict=True), strict=True))

        return make

    return start


def predict(docs: DataFrame, model: C.Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's mean probability over all words), certainty (the mean probability
    of each word's best label, which switches of language don't lower), n_switches (words whose label differs from
    that before).

    ``und`` with score 0 for a null text or one without letters, and where nothing was learned. Repeated rows
    are predicted each; a null id stays null; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS rows of labels
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_texts(own, LABELS, _predict(shared), at_once=2_500)


def recognised(docs: DataFrame, model: C.Crf, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns: not ``und``, and with a
    certainty of at least ``least``. Texts in several languages count as recognised if their words do."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    start = _predict(shared)

    def flag() -> Callable[[list[str]], dict]:
        make = start()

        def run(texts: list[str]) -> dict:
            got = make([t or "" for t in texts])
            return {"__stays": [lang != UNKNOWN and c >= least for lang, c in zip(got["lang_pred"], got["certainty"], strict=True)]}

        return run

    return map_texts(docs, "__stays boolean", flag, text_col, keep_text=True, at_once=2_500).where("__stays").drop("__stays")


def fit_training_fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> C.Crf:
    return fit(docs.where(fold(id_col, 4) != 2), id_col=id_col, text_col=text_col, lang_col=lang_col, **how)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Fits on the rows whose fold (crc32 of the id, mod 4) is not 2 and predicts all rows:
    doc_id, held_out, lang_pred, score, certainty, n_switches."""
    model = fit_training_fold(docs, id_col, text_col, lang_col, **how)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs, model, id_col, text_col).select("doc_id", held_out, "lang_pred", "score", "certainty", "n_switches")
