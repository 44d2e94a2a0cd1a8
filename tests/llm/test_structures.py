"""Alignment, manifest and chat formatting against brute force, on nulls, ties, empty tables, long texts and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import alignment, chat, merkle

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, pair long, n long, best boolean, idx long, gid long, digest string, path string, pos long"
TEXTS = [
    None, "", " ", "a", "Hello world", "two  spaces", " lead and trail ", "line one\nline two\n\nline four\tTab\r\nend", "a ▁ b", "<|endoftext|> and </s> <s> inside", "naïve café déjà vu 你好 🎉 ①", "x" * 500 + " " + "ab1" * 40,
    "Words1234 with-numbers, and 56.78! (punctuation)", "\0 nul \0", "Upper CASE Text", "Upper CASE Text",
]


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijéöß ") for _ in range(rng.randint(1, 9))).strip() or "w" for _ in range(200)]
    texts = TEXTS + [(rng.choice([" ", "\n"])).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [" ".join(rng.choice(words) for _ in range(20_000))]
    return [(None if i == 3 else 7 if i in (8, 9) else i * 3, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}" if i != 20 else "alone", None if i % 7 == 0 else len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, True, 4, 5, "d", "p", 6) for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- alignment -----------------------------------------------------------------------------------


def naive_alignment(texts):
    """For each text: n_a, n_b, n_groups, groups text, links as pairs of ids."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    out = []
    for t in texts:
        if not t:
            out.append((0, 0, 0, "", []))
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        raw_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            out.append((0, 0, 0, "", []))
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
        groups, at = [], [0, 0]
        place = [{e: k + 1 for k, e in enumerate(own)} for own in ends]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [p[cut] for p in place]
            groups.append(",".join(map(str, ids_a[at[0] : to[0]])) + "|" + ",".join(map(str, ids_b[at[1] : to[1]])))
            at = to
        links, j = [], 0
        for i, (s, e) in enumerate(zip([0, *ends[0]], ends[0], strict=False)):
            while j and ends[1][j - 1] > s:
                j -= 1
            while j < len(ids_b) and (ends[1][j - 1] if j else 0) < e:
                if ends[1][j] > s:
                    links.append((ids_a[i], ids_b[j]))
                j += 1
        out.append((len(ids_a), len(ids_b), len(groups), ";".join(groups), links))
    return out


def expected_alignment(rows):
    import collections

    made = naive_alignment([r[1] for r in rows])
    counts = collections.Counter(x for m in made for x in m[4])
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for r, (n_a, n_b, n_groups, said, links) in zip(rows, made, strict=True):
        digest = hashlib.sha256(said.encode()).hexdigest() if n_a else ""
        out.append((r[0], n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def key(r):
    return tuple((v is None, v) for v in r)


@pytest.mark.parametrize("sent_rows", [alignment.SENT_ROWS, 0])
def test_alignment_equals_brute_force(docs, rows, sent_rows):
    """Both ways of looking counts up."""
    got = [tuple(r) for r in alignment.aligned(docs, A, B, sent_rows=sent_rows).collect()]
    assert sorted(got, key=key) == sorted(expected_alignment(rows), key=key)
    assert sum(r[1] == 0 for r in got) >= 3


def test_walk_on_random_ends():
    """Groups and links of random cuts of the same bytes; long stretches of equal ends among them."""
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 300)
        share = rng.choice([0.1, 0.5, 0.95, 1.0])
        cuts = [[e for e in range(1, n) if rng.random() < (share if k else 0.6)] + [n] for k in range(2)]
        if rng.random() < 0.5:  # mostly the same ends
            cuts[1] = sorted({e for e in cuts[0] if rng.random() < 0.95} | {n})
        walk = alignment.Walk(*(np.array(c) for c in cuts))
        last_a, last_b = walk.groups()
        common = sorted(set(cuts[0]) & set(cuts[1]))
        assert [cuts[0][i] for i in np.flatnonzero(last_a)] == common == [cuts[1][i] for i in np.flatnonzero(last_b)]
        spans = [list(zip([0, *c], c, strict=False)) for c in cuts]
        links = sorted((i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e)
        assert sorted(zip(*(x.tolist() for x in walk.links()), strict=True)) == links


# --- manifest ------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def naive_manifest(rows, fan=16):
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        """The last node and each node's (left, right) by level."""
        levels, paths = [nodes], [[] for _ in nodes]
        while len(levels[-1]) > 1:
            now, k = levels[-1], len(levels) - 1
            for i in range(len(nodes)):
                at = i // fan**k
                start = at // fan * fan
                run = now[start : start + fan]
                paths[i].append(("".join(run[: at - start]), "".join(run[at - start + 1 :])))
            levels.append([sha(*now[s : s + fan]) for s in range(0, len(now), fan)])
        return levels[-1][0], paths

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1])), r) for r in rows if r[3] == s) for s in sources}
    trees = {s: tree([k[2] for k, _ in own[s]]) for s in sources}
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper, strict=True):
        subroot, paths = trees[s]
        for (k, r), path in zip(own[s], paths, strict=True):
            steps = path + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = leaf(r, r[1].translate(LOWER)) if changed else k[2]
            for left, right in steps:
                node = sha(left, node, right)
            out.append((r[0], k[2], subroot, root, sha(*(x for step in steps for x in step)), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fan", [16, 3])
def test_manifest_equals_brute_force(spark, docs, rows, fan):
    got = [tuple(r) for r in merkle.digest(merkle.manifest(docs, fan=fan)).select(COLUMNS).collect()]
    assert sorted(got, key=key) == sorted(naive_manifest(rows, fan), key=key)
    assert 0 < sum(r[-1] for r in got)


def test_manifest_of_one_source_with_most_rows(spark):
    """900 rows of one source, of 1000; some texts have nothing to lower."""
    rows = [(i, f"Text {i}" if i % 3 else f"text {i}", "en", "hot" if i % 10 else f"s{i}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = [tuple(r) for r in merkle.digest(merkle.manifest(df)).select(COLUMNS).collect()]
    assert sorted(got) == sorted(naive_manifest(rows))
    assert any(not r[-1] for r in got)


def test_lone_leaf(spark):
    df = spark.createDataFrame([(5, "A", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.digest(merkle.manifest(df)).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("")


# --- chat ----------------------------------------------------------------------------------------

SAID = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi </s> [INST]"), (1, 2, "assistant", "[/INST] ~ <~s> <~~s> [~INST]"), (1, 3, "user", "a\nb"), (1, 4, "assistant", ""),
    (2, 0, "user", None), (2, 1, "assistant", "é🎉"), (2, 2, "user", "last word"),
    (3, 0, "assistant", "first"), (3, 1, "assistant", "again"), (4, 0, "tool", "[ROLE]x[TEXT]"), (4, 1, None, "[/TEXT]"), (4, 2, "[TEXT]~", "odd"),
    (5, 1, "user", "tie b"), (5, 1, "user", "tie a"), (5, 1, "user", "tie a"), (5, None, "system", "no turn"), (None, 0, "user", "no id"), (None, 1, "assistant", "</s" + ">" * 3 + "<" * 3 + "s>"),
]


def test_chat_round_trip(spark):
    rng = random.Random(9)
    odd = ["[INST]", "[/INST]", "</s>", "<s>", "<SYS>", "[ROLE]", "[TEXT]", "~", "[", "<", "s>", "INST]", " ", "\n", "é", "$1", "\\"]
    said = SAID + [(100 + k, t, rng.choice(["system", "user", "assistant", "tool", "".join(rng.choice(odd) for _ in range(3))]), "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))) for k in range(120) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({"valid": F.lit(1), "turns": F.lit("x"), "segments": F.lit(2)}).repartition(4)
    made = chat.formatted(df)
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    texts = {r["conv_id"]: r for r in made.collect()}
    rule = chat.Template()
    for conv in {s[0] for s in said}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((s for s in said if s[0] == conv), key=lambda s: (s[1] is not None, s[1] or 0, s[2] or "", s[3] or ""))]
        r = got[conv]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha(*(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(learned), sha(learned), len(texts[conv]["text"]))
        state, bad = "start", None
        for k, (role, _) in enumerate(turns):
            state = rule.moves.get((state, role), "lost")
            bad = k if state == "lost" and bad is None else bad
        assert (r["valid"], r["bad_turn"] if "bad_turn" in r else texts[conv]["bad_turn"]) == (bad is None and state in rule.final, bad)
        assert "".join(s["text"] for s in texts[conv]["segments"]) == texts[conv]["text"]


def test_chat_long_conversation(spark):
    """3000 turns, one of a million characters."""
    said = [(1, t, "assistant" if t % 2 else "user", "[INST] " * 150_000 if t == 7 else f"turn {t}") for t in range(3000)]
    r = chat.digest(chat.formatted(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).first()
    assert r["n_turns"] == 3000 and r["valid"] and r["loss_sha256"] == sha(*(s[3] for s in said if s[2] == "assistant"))


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(other=("[A]", "[A]B", "[C]"))
    with pytest.raises(ValueError):
        chat.Template(other=("ROLE", "[TEXT]", "[/TEXT]"))


def test_empty_tables(empty, spark):
    assert alignment.aligned(empty, A, B).count() == 0
    assert alignment.aligned(empty, A, B, sent_rows=-1).count() == 0
    assert merkle.manifest(empty).count() == 0
    assert chat.digest(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_labeller_gives_back_every_labelled_kind():
    """The labels of its own training rows come out, those with even numbers among them."""
    import collections

    from tidewheel.llm import pii

    rows = pii.LABELLED.strip().split("\n")
    tagger = pii.Tagger(rows)
    want, got = collections.Counter(), collections.Counter()
    for words, labels in pii.parse_labelled(rows):
        found = {k for k, *_ in tagger.spans([" ".join(words)])[0]}
        for kind in set(labels) - {"O"}:
            want[kind] += 1
            got[kind] += kind in found
    assert len(want) >= 5 and all(got[k] >= 0.9 * n for k, n in want.items()), (want, got)
