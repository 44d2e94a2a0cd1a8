"""The corpus operators against brute force on small tables, and on nulls, ties, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import components, crf, exact_dedup, fuzzy_passages, language, lm, mixing, near_dedup, packing, pii, quality_rules, substrings
from tidewheel.llm.base import fold

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, hub string, key long, n long, row long, id long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(n=60, seed=0):
    """Invented texts with copies, near copies, shared passages, empty and null ones."""
    rng = random.Random(seed)
    letters = {"en": "thander ing of", "de": "schung ein üd", "fr": "eaux lé ouç"}
    vocabulary = {k: ["".join(rng.choice(v.split()) for _ in range(rng.randint(1, 3))) + rng.choice("abcdefgh") for _ in range(150)] for k, v in letters.items()}
    passage = " ".join(rng.choice(vocabulary["en"]) for _ in range(60))
    texts = []
    for i in range(n):
        lang = rng.choice(list(letters))
        w = [rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 120))]
        kind = i % 6
        if texts and kind == 1:
            old = rng.choice(texts)
            texts.append((old[0].replace(" ", "\n  ", 1), old[1]))
        elif texts and kind == 2:
            old, lang = rng.choice(texts)
            w = old.split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            texts.append((" ".join(w), lang))
        elif kind == 3:
            texts.append((" ".join(w[:20]) + " " + passage + " " + " ".join(w[20:]), "en"))
        else:
            texts.append((" ".join(w).capitalize(), lang))
    rows = [(i * 3 + 1, t, lang, f"src{i % 3}" if i % 7 else None) for i, (t, lang) in enumerate(texts)]
    rows += [(1000, None, None, None), (1001, "", "en", "src1"), (1002, " \n\t ", None, "src0"), (1003, "12 34 !!", "de", "src2"), (1004, "x" * 300 + " " + "y" * 300, "en", "src0")]
    return [(*r, "h", 1, 2, 3, 4) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return df.toPandas().set_index("doc_id")


@pytest.mark.parametrize("hot", [exact_dedup.HOT, 1])
def test_exact_dedup(docs, rows, hot):
    got = by_id(exact_dedup.exact_dedup(docs, bits=1, hot=hot))
    assert len(got) == len(rows)
    norm = {r[0]: WS.sub(" ", r[1] or "") for r in rows}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for i, t in norm.items():
        r = got.loc[i]
        assert (r.keep_id, r.group_size, bool(r.kept), r.text_sha256) == (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest())


def test_drop_copies_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (4, "a\tb"), (None, "c")], "doc_id long, text string")
    got = exact_dedup.drop_copies(df)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_drop_copies_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "a  b", "y"), (None, "c", "z")], "doc_id long, text string, keep_id string")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 1]


def reference_near(rows, k, threshold=80):
    sets = {}
    for r in rows:
        w = [x for x in WS.split((r[1] or "").translate(LOWER)) if x]
        sets[r[0]] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(docs, rows, k):
    got = by_id(near_dedup.near_dedup(docs, shingle=k))
    expected = reference_near(rows, k)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.iterrows()} == expected
    assert all(bool(r.kept) == (expected[i][1] == i) for i, r in got.iterrows())


def test_near_dedup_chains_through_one_text(spark):
    """a ~ b and b ~ c, but a is not like c: all are one component, whichever is the hub."""
    w = [f"w{i}" for i in range(100)]
    texts = [w, w[:90] + [f"x{i}" for i in range(8)], w[8:90] + [f"x{i}" for i in range(16)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(near_dedup.near_dedup(df, shingle=1))
    assert got.component_id.tolist() == [0, 0, 0] and reference_near([(i, " ".join(t)) for i, t in enumerate(texts)], 1)[2][1] == 0


def near_family(n, seed, words=120, most=0.4):
    """One text and copies with up to 40 % of the words replaced or dropped: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        share = rng.random() * most * 0.3
        w = [x if rng.random() > share else f"x{rng.randrange(10**6)}" for x in base if rng.random() > share / 4]
        out.append((i * 2 + 5, " ".join(w)))
    return out


@pytest.mark.parametrize("small", [16, 512])
def test_near_dedup_hot_family(spark, small):
    """Groups of every size are compared by hubs, or pair by pair, with the same links."""
    rows = near_family(150, 3)
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=4, small=small))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.iterrows()} == reference_near(rows, 4)
    assert 5 < got.component_id.nunique() < 140


def test_near_dedup_pairs_of_a_hot_family(spark, monkeypatch):
    """Copies of one text that are mostly not alike: four times as many have less than eight times the pairs to compare."""
    written, compared = near_dedup.materialize, {}

    def counted(df, tag, **how):
        out = written(df, tag, **how)
        compared[tag] = compared.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    found = {}
    for n in (100, 400):
        rows = near_family(n, 3)
        compared.clear()
        got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4))
        assert {i: (r.n_shingles, r.component_id) for i, r in got.iterrows()} == reference_near(rows, 4)
        found[n] = compared["pairs"]
    assert found[400] < 8 * max(found[100], 25), found


def test_ranked_prefixes_meet():
    """The same as below for any order that is the hub's."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(4000):
        base, order = np.arange(60, dtype=np.uint64), rng.random(75)
        sets = []
        for _ in range(3):
            keep = base[rng.random(60) > rng.random() * 0.25]
            sets.append(np.unique(np.concatenate([keep, rng.integers(60, 75, rng.integers(0, 12)).astype(np.uint64)])))
        hub, x, y = sets
        rank = lambda lacked, alone, order=order: np.concatenate([order[lacked], order[alone]])
        (ax, _, px), (ay, _, py) = near_dedup.prefix(hub, x, 80, rank), near_dedup.prefix(hub, y, 80, rank)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both) and not (ax and ay):
            met += 1
            assert len(np.intersect1d(px, py))
    assert met > 100


def test_prefixes_meet():
    """Sets that are alike and not both like the hub share an element of their prefixes."""
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(4000):
        base = np.arange(60, dtype=np.uint64)
        sets = []
        for _ in range(3):
            keep = base[rng.random(60) > rng.random() * 0.25]
            sets.append(np.unique(np.concatenate([keep, rng.integers(60, 75, rng.integers(0, 12)).astype(np.uint64)])))
        hub, x, y = sets
        (ax, dx, px), (ay, dy, py) = near_dedup.prefix(hub, x, 80), near_dedup.prefix(hub, y, 80)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both) and not (ax and ay):
            met += 1
            assert len(np.intersect1d(px, py)) and 180 * abs(dx - dy) <= 20 * (len(x) + len(y))
    assert met > 100


def test_near_dedup_rows_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text), (7, text), (7, "other words " + "x y z " * 5), (None, text + " more"), (None, "alone in the world here"), (2**53 + 1, text), (None, None), (9, "")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in got)
    assert found == [(-1, -1, True), (-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True), (7, 7, True), (9, 9, True), (2**53 + 1, 7, False)]


def test_near_dedup_differences_leave_in_parts():
    """A batch of pairs isn't held with all its differences."""
    own = [np.arange(k, k + 30, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for k in range(2500)]
    pairs = pd.DataFrame({"a": 0, "b": np.arange(2500), "members_a": own[0], "members_b": own, "more": True})
    got = list(near_dedup._compare(80)(iter([pairs])))
    assert max(map(len, got)) <= 1000 and np.concatenate([g["b"] for g in got]).tolist() == list(range(2500))


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    random.Random(1).shuffle(chain)
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("at_once", [1, 7, 1_000_000])
def test_components_contract_what_a_task_reads(spark, monkeypatch, at_once):
    """Edges around hubs are stars at once, in no round; whatever meets in a task, the components are right."""
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    tags, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, tag: tags.append(tag) or write(df, tag))
    around = spark.createDataFrame([(5, b) for b in (9, 7, 8)] + [(20, 21)], "a long, b long").coalesce(1)
    assert {tuple(r) for r in components.components(around).collect()} == {(5, 5), (7, 5), (8, 5), (9, 5), (20, 20), (21, 20)} and len(tags) == 1
    rng = random.Random(at_once)
    edges = [(rng.randrange(60) * 7 - 99, rng.randrange(60) * 7 - 99) for _ in range(45)]
    want = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


@pytest.mark.parametrize("hot", [1000, 0])
def test_substrings(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", hot)
    got = by_id(substrings.substring_dedup(docs, digest=True))
    first = {}
    for i, t in sorted((r[0], (r[1] or "").encode()) for r in rows):
        own = [t[k : k + 50] for k in range(len(t) - 49)]
        gone = bytearray(len(t))
        for k, s in enumerate(own):
            if first.setdefault(s, i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        r = got.loc[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_substrings_part_hot_names(spark, monkeypatch):
    """A core with many contexts is parted by the bytes beside it: only a half that is as common is spread by window, and nothing is lost."""
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", 8)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    core, twin = letters(40), letters(90)
    texts = [letters(60) + core + letters(60) for _ in range(40)] + [twin[:25] + core + twin[65:], letters(40) + twin[:25] + core + twin[65:] + letters(40)]
    tables = {}
    write = substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df, tag, **how: tables.setdefault(tag, write(df, tag, **how)))
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    got = {(r["doc"], k) for r in substrings.repeated_spans(own, None).collect() for k in range(r["start"], r["stop"])}
    first, want = {}, set()
    for i, x in enumerate(texts):
        for k in range(len(x) - 49):
            if first.setdefault(x[k : k + 50], i) < i:
                want |= {(i, k + j) for j in range(50)}
    assert got == want and want
    assert tables["open-places"].where("n_ctx > 8").count() > 30 and tables["windows"].count() == 0


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    got = packing.packed(docs, TOKENIZER, capacity=64, ids=True).toPandas().sort_values(["doc_id", "piece"])
    tok = Tokenizer.from_file(TOKENIZER)
    for r in rows:
        own = got[got.doc_id == r[0]]
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        assert [int(x) for p in own.ids for x in p] == ids
        assert own.piece.tolist() == list(range(len(own))) and (own.length[1:] == 64).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own.ids]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 64 + 1


def test_packing_carries_little(spark):
    items = spark.range(500).select(F.col("id").alias("row"), (F.col("id") % 40 + 1).alias("length")).repartition(9)
    got = packing.pack(items, capacity=50, carry=3, fan_in=2).join(items, "row").toPandas()
    assert len(got) == 500 and (got.groupby("sequence_id").length.sum() <= 50).all()


@pytest.mark.parametrize("load", [1000, 7])
def test_packing_merges_open_bins_as_items(spark, load):
    """Bins of 20 of 100 places in 23 nodes: the tree fills bins with five of them, each a run of rows that stays together."""
    schema = "closed boolean, node long, rows array<long>, lengths array<long>, offsets array<long>"
    bins = [(False, k % 23, [2 * k, 2 * k + 1], [15, 5], [0, 15]) for k in range(115)] + [(True, 0, [999], [100], [0])]
    closed, rest = packing.merge_tree(spark.createDataFrame(bins, schema), 100, 0, load, 4)
    done = [r for t in closed for r in t.collect()]
    every = done + rest.collect()
    assert sorted(x for b in every for x in b.rows) == [*range(230), 999]
    assert all(sum(b.lengths) <= 100 and b.offsets == [sum(b.lengths[:k]) for k in range(len(b.lengths))] for b in every)
    assert all(b.rows[k + 1] == b.rows[k] + 1 for b in every if len(b.rows) > 1 for k in range(0, len(b.rows), 2))
    assert len(every) == 24 if load == 1000 else len(every) <= 30  # 23 and the one that was full


def test_packing_keeps_every_open_bin(spark):
    """A stretch of items of 60 % of a bin, whose partners of 40 % lie in other partitions."""
    items = spark.range(800).select(F.col("id").alias("row"), F.when(F.col("id") < 400, 30).otherwise(20).cast("long").alias("length")).repartitionByRange(8, "row")
    got = packing.pack(items, capacity=50, carry=32, fan_in=8).join(items, "row").toPandas()
    assert len(got) == 800 and (got.groupby("sequence_id").length.sum() <= 50).all()
    assert got.sequence_id.nunique() <= 420  # 400 is the lower bound


@pytest.mark.parametrize("text", ["", " a", "a  b", "a\n\nb", "it's 12\t3", "<|endoftext|> x<|endoftext|>", "é ü ç 日本", "a\x1cb c", "x \n y", "A b c"])
def test_encoder_equals_tokenizer(text):
    e = packing.Encoder(TOKENIZER)
    assert e.fast and e(text) == e.whole(text)


def test_mixing(docs, rows):
    got = by_id(mixing.mix(docs, block_docs=4, shards=5))
    again = by_id(mixing.mix(docs.repartition(2), block_docs=4, shards=5))
    assert got.taken.to_dict() == again.taken.to_dict()
    size = {r[0]: len([w for w in WS.split(r[1] or "") if w]) for r in rows}
    assert got["size"].to_dict() == size and (got.taken <= 3 * got["size"]).all()
    per = got.assign(source=got.source.fillna("~")).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(sum(size.values()))
    assert (abs(per.taken - per.target) <= 120).all()  # a document at most
    assert all(len(r.places) * r["size"] == r.taken for _, r in got.iterrows())


def test_mixing_of_mostly_empty_texts(spark):
    """Blocks without words take no place from the rest's blocks."""
    rows = [(i, "word " * 30 if i % 20 == 0 else None if i % 2 else "", "a" if i < 1200 else "b") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=4, shards=5)
    per = got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(per) == 2 and all(abs(r["taken"] - r["target"]) <= 30 for r in per), per  # a document at most


def test_targets_stop_at_three_times(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert got["a"] == 30 and got[None] == 15 and sum(got.values()) == pytest.approx(2015)
    assert got["b"] / got["c"] == pytest.approx(2)


def test_split_quotas_are_exact(spark):
    q = spark.createDataFrame([(1, 7), (2, 100), (3, 0)], "source_no int, blocks long")
    got = mixing.split_quotas(q, shards=5).toPandas()
    assert got.groupby("source_no").n.sum().to_dict() == {1: 7, 2: 100, 3: 0}
    assert got.groupby("shard").n.sum().between(21, 22).all()
    for _, s in got[got.n > 0].groupby("source_no"):
        s = s.sort_values("first")
        assert s["first"].tolist() == [0, *np.cumsum(s.n)[:-1]]


def brute_paths(model, e):
    from itertools import product

    k, n = len(model.labels), len(e)
    every = {}
    for y in product(range(k), repeat=n):
        every[y] = model.start[y[0]] + sum(e[t, y[t]] for t in range(n)) + sum(model.transitions[y[t], y[t + 1]] for t in range(n - 1))
    return every


def test_crf_against_all_paths():
    rng = np.random.default_rng(0)
    model = crf.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    lengths = np.array([3, 1, 5, 4])
    e = rng.normal(0, 2, (lengths.sum(), 3))
    p, best = crf.forward_backward(model, e, lengths), crf.viterbi(model, e, lengths)
    at = 0
    for n in lengths:
        paths = brute_paths(model, e[at : at + n])
        z = sum(map(math.exp, paths.values()))
        want = np.zeros((n, 3))
        for y, s in paths.items():
            want[np.arange(n), y] += math.exp(s) / z
        assert np.allclose(p[at : at + n], want) and tuple(best[at : at + n]) == max(paths, key=paths.get)
        at += n


def test_pii_base_spans(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-@. 1") for _ in range(rng.randint(0, 25)))
        assert list(pii.emails(t)) == [m.span() for m in email.finditer(t)]
    text = "a.b@c.de 1.2.3.4 and 300.1.1.1 or 4111 1111 1111 1111 and 4111111111111112 tel +1 (212) 555-0199 token = \"9f86d081884c7d659a2feaa0c55ad015\""
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = by_id(pii.digest(pii.find_pii(df)))
    assert got.loc[1, ["n_email", "n_ip", "n_card", "n_phone"]].tolist() == [1, 1, 1, 1]
    assert f"secret:{text.index('9f86')}:{len(text) - 1}" in got.loc[1, "spans"]
    assert got.loc[2, "spans"] == got.loc[3, "spans"] == "" and got.loc[2, "base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id(pii.redact(df)).loc[1, "text"].startswith("[email] [ip]")


def test_pii_leaves_clean_text_alone(spark):
    clean = ["in the year 1984 about 3.5 percent", "version 10.2.1 of 12 items", "chapter 3, page 256", "12 + 30 = 42", "under CC BY-NC 4.0."]
    got = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"))).toPandas()
    assert got.spans.tolist() == [""] * len(clean)


def test_language(docs, rows):
    got = by_id(language.identify(docs))
    lang = {r[0]: r[2] for r in rows}
    good = [i for i in got.index if i < 1000]
    assert np.mean([got.lang_pred[i] == lang[i] for i in good]) > 0.9
    assert got.lang_pred[1000] == got.lang_pred[1001] == got.lang_pred[1003] == "und" and got.score.between(0, 1).all()
    assert all(bool(got.held_out[i]) == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)


def test_language_follows_a_switch(docs):
    model = language.fit(docs)
    words = [r["text"].split()[:15] for lang in ("en", "de") for r in docs.where((F.col("lang") == lang) & (F.col("doc_id") < 1000)).orderBy("doc_id").limit(1).collect()]
    p = next(language.Labeller(model).probabilities([words[0] + words[1]])).argmax(axis=1)
    names = np.array(model.labels)[p]
    assert (names[: len(words[0])] == "en").mean() > 0.7 and (names[len(words[0]) :] == "de").mean() > 0.7


def reference_signals(text):
    w = [x for x in WS.split(text) if x]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = collections.Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WS.sub("", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_signals(spark):
    texts = [None, "", "a b\na b\n \n \na b", "w " * 30, " ".join(map(str, range(30))) * 2, "# $a\n" * 12, "é ü " * 9 + "z"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 0), (99, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.quality_rules(df, labels))
    for i, t in enumerate(texts):
        r = got.loc[i]
        want = reference_signals(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert bool(r.base_failed) == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_risk_controlled_cutoffs(spark):
    """Cutoffs are where the exact bound allows, and never where it doesn't."""
    rng = np.random.default_rng(0)
    share = rng.uniform(0, 0.1, 4000)
    pdf = pd.DataFrame({"stratum": ["big"] * 3990 + ["few"] * 10, "n_words": 100, "word_chars": 1000, "n_symbols": (1000 * share).astype(int), "n_lines": 1, "n_dup_lines": 0, "n_repeat_words": 0})
    got = quality_rules.thresholds(spark.createDataFrame(pdf)).toPandas()
    assert set(got.stratum) == {"big"}
    cut = got[got.rule == "symbol_share"].cutoff.item()
    rejected = int((pdf.n_symbols[:3990] / 1000 > cut).sum())
    risk, level = 0.05 / 4, 0.05 / 8
    cdf = sum(math.exp(math.lgamma(3991) - math.lgamma(i + 1) - math.lgamma(3991 - i) + i * math.log(risk) + (3990 - i) * math.log1p(-risk)) for i in range(rejected + 1))
    assert cdf <= level and cut == 0.1


@pytest.mark.parametrize("most", [10**6, 0])
def test_lm_base_scores(docs, rows, most):
    got = by_id(lm.lm_scores(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, hot_words=most, least_docs=20))
    tokens = {r[0]: [*(w for w in WS.split((r[1] or "").translate(LOWER)) if w), None] for r in rows}
    count = collections.Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
    total = sum(count.values())
    for i, ts in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(count[t] > 0 for t in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in ts)) and r.score < 0


def test_lm_scores_are_the_same_however_many_words_are_sent(docs):
    """Frequent words are told in the scoring tasks and all others by a join: one formula for both."""
    one, other = (by_id(lm.lm_scores(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, hot_words=most, least_docs=20)) for most in (10**6, 0))
    assert np.allclose(one.score, other.loc[one.index].score, rtol=1e-9, atol=0) and (one.n_known == other.loc[one.index].n_known).all()


def test_lm_sums_up_a_tree(spark, monkeypatch):
    """Changes of more tasks than one group takes are summed up a tree."""
    monkeypatch.setattr(lm, "TASK_DOCS", 2)
    texts = [(i, " ".join(f"w{(i * 7 + k) % 13}" for k in range(20))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm.lm_scores(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).toPandas()
    assert len(got) == 60 and np.isfinite(got.score).all() and got.score.sum() > 2 * got.base_score.sum()


def test_lm_trains_on_the_whole_fold(spark, monkeypatch):
    """Every text of the training fold reaches the training, once over all rounds, and no other."""
    read, parts, whole = [], [], lm.trained
    df = spark.createDataFrame([(i, f"a{i} b c{i} d " * 9) for i in range(400)], "doc_id long, text string")

    def spy(texts, n_docs, *args, **how):
        read.append((texts.count(), texts.select("u").distinct().count(), n_docs))
        where = type(texts).where
        monkeypatch.setattr(type(texts), "where", lambda d, c: parts.append(where(d, c)) or parts[-1])
        model = whole(texts, n_docs, *args, **how)
        monkeypatch.setattr(type(texts), "where", where)
        parts[:] = [p.count() for p in parts]
        return model

    monkeypatch.setattr(lm, "trained", spy)
    lm.lm_scores(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, least_docs=20).count()
    fold_size = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(400))
    assert read == [(fold_size, fold_size, fold_size)] and len(parts) == lm.ROUNDS and sum(parts) == fold_size


def test_lm_encodes_new_words_together():
    """Subwords of many words come from one call of the tokenizer, and are those of each word alone."""
    sub = lm.Subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    words = ["the", "it's", "'s", "x1y2", "...", "na\u00efve", "\u4f60\u597d", "\U0001f600", "antidisestablishmentarianism", "-", "3,000.5", "a" * 300]
    odd = [*words, "a\u00a0b", "\u2028", "c\x1cd", "e"]
    alone = {w: sub.tokens.encode_ordinary(" " + w) for w in odd}

    def parts(own):
        ids, size = sub.of(own)
        return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]

    assert parts(odd) == [alone[w] for w in odd]  # with other white space inside
    calls, whole = [], sub.tokens
    sub.tokens = types.SimpleNamespace(encode_to_numpy=lambda t: calls.append(t) or whole.encode_to_numpy(t))
    assert parts(words) == [alone[w] for w in words] and parts(words[::-1]) == [alone[w] for w in words[::-1]] and len(calls) == 2
    assert [len(x) for x in sub.of([])] == [0, 0]


def test_lm_scores_of_a_partition_without_words(spark):
    df = spark.createDataFrame([(1, None), (2**60, ""), (None, "x y z"), (None, "x\u00a0y z")], "doc_id long, text string").repartition(4, "text")
    got = lm.lm_scores(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3, 4]


def test_lm_windows_are_causal_and_sum_to_one():
    rng = np.random.default_rng(1)
    size = 40
    ids = [rng.integers(0, size - 1, n).astype(np.int32) for n in (70, 1, 33)]
    counts = np.bincount(np.concatenate(ids), minlength=size).astype(float)
    model = lm.train(ids, size, counts, epochs=1)
    score = lm.Scorer(model, size)
    each = [score([np.append(ids[0][:20], np.int32(k))])[0] for k in range(size)]
    before = score([ids[0][:20]])[0]
    assert sum(10 ** (e - before) for e in each) == pytest.approx(1, rel=1e-4)
    assert np.allclose(score(ids), [score([x])[0] for x in ids], rtol=1e-5)


def test_lm_gradients():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 9, 40).astype(np.int32)]
    model = lm.train(ids, 10, np.ones(10), epochs=0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y, _ = lm.blocks(ids, 9)
    rows_ = np.flatnonzero((y >= 0).any(axis=1))
    target = np.where(y >= 0, model.klass[np.maximum(y, 0)], -1)
    used, g, _ = lm.gradients(model, x[rows_], x[rows_ - 1], target[rows_])
    whole = np.zeros_like(model.p["E"])
    whole[used] = g["E"]
    g["E"] = whole
    for name in model.p:
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        at = (int(ids[0][3]), *at[1:]) if name == "E" else at
        old, eps = model.p[name][at], 1e-5
        loss = []
        for v in (old + eps, old - eps):
            model.p[name][at] = v
            loss.append(lm.gradients(model, x[rows_], x[rows_ - 1], target[rows_])[2])
        model.p[name][at] = old
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), rel=2e-3, abs=1e-7), name


def test_chain_against_quadratic():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        xy = np.unique(np.stack([rng.integers(0, 25, n), rng.integers(0, 25, n)], 1), axis=0)
        x, y = xy[:, 0], xy[:, 1]
        score, _ = fuzzy_passages.chain(x, y)
        want = np.zeros(len(x))
        for i in range(len(x)):
            best = max([want[j] - fuzzy_passages.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]] + [0.0])
            want[i] = fuzzy_passages.SEED + best
        assert np.allclose(score, want)


def test_fuzzy_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(80)]
    edited = [w if i % 11 else "edit" for i, w in enumerate(shared)]
    text = lambda a, m, b: " ".join([word() for _ in range(a)] + m + [word() for _ in range(b)])
    df = spark.createDataFrame([(1, text(30, shared, 10)), (2, text(5, edited, 40)), (3, text(50, [], 50)), (4, text(0, shared, 0)), (5, None), (6, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"]): r for r in fuzzy_passages.fuzzy_passages(df).collect()}
    assert set(got) == {(2, 1), (4, 1), (4, 2)}  # the first and the document before
    assert got[4, 1]["identity"] == 1 and (got[4, 1]["start"], got[4, 1]["stop"], got[4, 1]["other_start"]) == (0, 80, 30)
    assert got[2, 1]["identity"] > 0.85 and got[2, 1]["stop"] - got[2, 1]["start"] >= 75


def brute_segments(runs, min_words, identity):
    """The same by trying every pair of ends, without prefix sums or early stops."""
    found = []
    for i in range(len(runs)):
        for j in range(i, len(runs)):
            (x, y, n), (ex, ey, en) = runs[i], runs[j]
            if min(n, en) >= fuzzy_passages.SEED:
                agree, dx, dy = sum(r[2] for r in runs[i : j + 1]), ex + en - x, ey + en - y
                if min(dx, dy) >= min_words and agree >= identity * max(dx, dy):
                    found.append((-agree, i, j))
    if not found:
        return set()
    top, i, j = min(found)
    own = (runs[i][0], runs[j][0] + runs[j][2], runs[i][1], runs[j][1] + runs[j][2], -top)
    return {own} | brute_segments(runs[:i], min_words, identity) | brute_segments(runs[j + 1 :], min_words, identity)


def test_fuzzy_segments_against_brute_force():
    rng = np.random.default_rng(3)
    several = 0
    for _ in range(300):
        steps = rng.integers(0, 12, (int(rng.integers(1, 14)), 2)) * rng.integers(0, 4)
        n = rng.integers(1, 40, len(steps))
        at = np.cumsum(steps + np.concatenate([[0], n[:-1]])[:, None], axis=0)
        runs = np.concatenate([at, n[:, None]], 1)
        got = list(fuzzy_passages.segments(runs))
        assert set(got) == brute_segments(runs.tolist(), fuzzy_passages.MIN_WORDS, fuzzy_passages.IDENTITY) and len(set(got)) == len(got)
        several += len(got) > 1
    assert several > 20


def test_fuzzy_passages_two_of_a_pair_and_a_stray_seed(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    head, foot, whole, stray = words(50), words(50), words(60), words(30)
    df = spark.createDataFrame(
        [(i, " ".join(m)) for i, m in enumerate([
            words(7) + head + words(100) + foot + words(5), head + words(100) + foot,  # a header and a footer
            whole + words(25) + stray + words(9), words(4) + whole + words(31) + stray,  # a short match near a passage
        ])], "doc_id long, text string",
    )
    got = {(r["doc_id"], r["other_id"], r["start"], r["stop"], r["other_start"], r["other_stop"], r["n_agree"]) for r in fuzzy_passages.fuzzy_passages(df).collect()}
    assert got == {(1, 0, 0, 50, 7, 57, 50), (1, 0, 150, 200, 157, 207, 50), (3, 2, 4, 64, 0, 60, 60)}


def test_fuzzy_passages_of_a_mosaic(spark):
    """A passage is found whole although smaller documents hold overlapping parts of it."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    whole = words(80)
    rows = [(i, words(20) + whole[10 * i - 10 : 10 * i + 20] + words(20)) for i in range(1, 7)]
    rows += [(100, words(30) + whole + words(10)), (101, words(5) + whole + words(40))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [(r["doc_id"], r["other_id"], r["start"], r["stop"]) for r in fuzzy_passages.fuzzy_passages(df).collect()]
    assert (101, 100, 5, 85) in got


def test_fuzzy_passages_between_parts(spark):
    """Parts of a passage in documents before and between its two whole copies; a seed's batches may be cut anywhere."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    whole = words(80)
    rows = [(k + i, words(20) + whole[10 * i - 10 : 10 * i + 20] + words(20)) for k in (0, 149) for i in range(1, 7)]
    rows += [(100, words(30) + whole + words(10)), (201, words(5) + whole + words(40))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [(r["doc_id"], r["other_id"], r["start"], r["stop"], r["other_start"]) for r in fuzzy_passages.fuzzy_passages(df).collect()]
    assert (201, 100, 5, 85, 30) in got


@pytest.mark.parametrize("listed", [1, 1000])
def test_fuzzy_passages_of_all_pairs(spark, monkeypatch, listed):
    """Every pair of edited copies is linked, however many documents share the seeds; a copy of a whole text has a row to the smallest one."""
    monkeypatch.setattr(fuzzy_passages, "LISTED", listed)
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    whole, rows = words(90), []
    for i in range(12):
        copy = list(whole)
        for at in rng.sample(range(90), 7):
            copy[at] = words(1)[0]
        rows.append((i * 50, " ".join(words(10) + copy + words(10))))
    rows.append((1000, rows[3][1].upper().replace(" ", "\n", 5)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = [i for i, _ in rows[:-1]]
    every = {(d, e) for d in ids for e in ids if d > e} | {(1000, 150)}
    found = lambda **k: {(r["doc_id"], r["other_id"]) for r in fuzzy_passages.fuzzy_passages(df, **k).collect()}
    assert found() == every
    # document 150 is a query because its copy 1000 is one
    assert found(queries=F.col("doc_id") % 100 == 0) == {(d, e) for d, e in every if d % 100 == 0 or e % 100 == 0 or 150 in (d, e)}


def test_fuzzy_passages_recall(spark):
    """Against brute force: every planted copy of 40 to 120 words with up to 20 % of the words replaced; 0.9 at least are found."""
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, planted = [], []
    for k in range(60):
        passage, share = words(rng.randint(40, 120)), rng.choice([0, 0.05, 0.1, 0.15])
        copy = [w if rng.random() > share else words(1)[0] for w in passage]
        if sum(a == b for a, b in zip(passage, copy, strict=True)) >= 0.8 * len(passage):
            rows += [(2 * k, words(40) + passage + words(30)), (2 * k + 1, words(15) + copy + words(60))]
            planted.append((2 * k + 1, 2 * k))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"]) for r in fuzzy_passages.fuzzy_passages(df).collect()}
    assert got <= set(planted) and len(got) >= 0.9 * len(planted), (len(got), len(planted))


BIG = 2**53 + 1


def test_ids_beside_null(spark, rows):
    """64-bit ids stay whole beside a null id in all operators that give a row for each row."""
    text = " ".join(r[1] for r in rows[:3])
    df = spark.createDataFrame([(BIG, text, "en", "a"), (None, text + " and more of it", "de", "a"), (3, "short text here", "en", None)], "doc_id long, text string, lang string, source string").coalesce(1)
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    made = [
        exact_dedup.exact_dedup(df), near_dedup.near_dedup(df), substrings.substring_dedup(df, digest=True), packing.packed(df, TOKENIZER), mixing.mix(df), pii.digest(pii.find_pii(df)), language.identify(df),
        quality_rules.quality_rules(df, labels), lm.lm_scores(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, least_docs=5),
    ]
    for got in made:
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == {BIG, None, 3}
    assert all(r["doc_id"] == BIG for r in fuzzy_passages.fuzzy_passages(spark.createDataFrame([(BIG, text), (1, text), (None, "x")], "doc_id long, text string")).collect())


def test_long_texts_and_repeated_rows(spark):
    """A text of 120,000 words, twice, beside rows that repeat an id."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(120_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long, "en", "a"), (3, "a b c d e f", "en", "b"), (3, "a b c d e f", "en", "b")], "doc_id long, text string, lang string, source string")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 2)}
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_dedup(df).collect()) == [(1, 1), (2, 1), (3, 3), (3, 3)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.substring_dedup(df, digest=True).collect()) == [(1, 0), (2, len(long)), (3, 0), (3, 0)]
    found = fuzzy_passages.fuzzy_passages(df).collect()
    assert [(r["doc_id"], r["other_id"], r["start"], r["stop"]) for r in found] == [(2, 1, 0, 120_000)]
    assert packing.packed(df, TOKENIZER).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert language.identify(df).count() == pii.find_pii(df).count() == 4
    assert {r["taken"] for r in mixing.mix(df).collect() if r["doc_id"] == 1} <= {0, 120_000, 240_000, 360_000}
    scored = lm.lm_scores(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, least_docs=5).toPandas()
    assert scored.n_tokens.tolist().count(120_001) == 2


def test_lm_learns_from_every_text(spark):
    """Rounds that share the fold leave no text out: each text has a subword of its own, and all of these have other vectors afterwards."""
    n, size = 120, 400
    rows = [(int(k) * 7919, np.array([k, 200, 201, k, 202 + k % 5, size - 1], "<u2").tobytes()) for k in range(n)]
    texts = spark.createDataFrame([(u, bytearray(ids)) for u, ids in rows], "u long, ids binary").repartition(3)
    counts = np.bincount(np.concatenate([np.frombuffer(ids, "<u2") for _, ids in rows]), minlength=size).astype(float)
    model = lm.trained(texts, n, counts, least_docs=10)
    before = lm.untrained(model.klass.astype(int), counts).p["E"]
    changed = (model.p["E"] != before).any(axis=1)
    assert changed[:n].all() and not changed[n:200].any()


def test_lm_beats_the_base_on_held_out_texts(spark):
    """Texts of a simple grammar: the model knows what follows what, the base only how often words are."""
    rng = random.Random(5)
    kinds = [["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(2)) for _ in range(12)] for _ in range(5)]
    text = lambda: " ".join(rng.choice(kinds[k % 5]) for k in range(rng.randrange(5), 60))
    df = spark.createDataFrame([(i, text()) for i in range(900)], "doc_id long, text string")
    got = lm.lm_scores(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.95 * got[1]


def test_pii_patterns_against_regular_expressions():
    """Base spans of every kind on random texts."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub(r"\D", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            own = [int(d) for d in digits[::-1]]
            return 13 <= len(digits) <= 19 and (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0
        return 9 <= len(digits) <= 15 if kind == "phone" else True

    rng = random.Random(8)
    n = collections.Counter()
    for _ in range(20_000):
        t = "".join(rng.choice(["1", "2", "25", "0", "4111 1111-", "1111", ".", ".", "+", "(", ")", " ", "-", "a", "@", "b.c", "1.2", "a@b.c", "+1 25", "\n"]) for _ in range(rng.randint(0, 24)))
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if good(k, m[0])]
        n.update(k for k, *_ in want)
        assert sorted(pii.base_spans(t)) == sorted(want), t
    assert all(n[k] > 20 for k in patterns)


def test_viterbi_around_equals_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(200):
        model = crf.Crf(["O", "a", "b"], np.zeros((1, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
        n = rng.integers(1, 9, 5)
        e = rng.normal(0, 3, (n.sum(), 3))
        e[:, 0] += 3
        assert (crf.viterbi_around(model, e, n) == crf.viterbi(model, e, n)).all()


def test_packing_is_near_the_best(spark):
    """Sizes of which pairs fill a bin: the lower bound is met within 2 %."""
    items = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, 10 + F.col("id") % 31).otherwise(90 - (F.col("id") - 1) % 31).cast("long").alias("length"))
    got = packing.pack(items, capacity=100).agg(F.countDistinct("sequence_id")).first()[0]
    assert 1500 <= got <= 1530


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert near_dedup.near_dedup(empty).count() == 0
    assert substrings.substring_dedup(empty).count() == 0
    assert packing.packed(empty, TOKENIZER).count() == 0
    assert mixing.mix(empty).count() == 0
    assert pii.find_pii(empty).count() == 0
    assert language.identify(empty).count() == 0
    assert fuzzy_passages.fuzzy_passages(empty).count() == 0
    assert lm.lm_scores(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    labels = empty.select("doc_id", F.lit(1).alias("quality"))
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_fold(spark):
    got = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)
