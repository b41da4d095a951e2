"""Token alignment, the n-gram join and hard negatives, each against a plain version."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codelore.llm import alignment, hard_negatives, ngram_join, queries

from test_text_operators import fuzzed, plain_components

SCHEMA = "doc_id long, text string"
TEXTS = [
    "The cat sat on the mat and then the cat sat again.", "", None, "  \n\t ", "éàü 日本語 😀 ￿ mixed  spaces\n\nlines", "word " * 3000, "x" * 5000, "a", "one two three four",
    "The cat sat on the mat and then the cat sat again.", "1234 5678 $$$ ### <s></s> <0x0A> <|endoftext|>", "İstanbul ŞÜ ﬁ", "\u0000nul\u0001", "a ▁ mark of the pieces", " " * 3000 + "end", "\n" * 1500,
]
PATHS = (P.path(queries.BYTE_BPE), P.path(queries.PIECES), P.PATTERN)


def plain_alignment(rows):
    """The contract's columns of every row, and the counts of pairs, token by token."""
    one, two = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    one.encode_special_tokens = True
    alphabet, counts, each = alignment.byte_alphabet(), Counter(), []
    for i, text in rows:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        raw_a = [bytes(alphabet[c] for c in one.id_to_token(x)) for x in a]
        raw_b = [bytes([int(two.id_to_piece(x)[3:-1], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if text and not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            a, b, raw_a, raw_b = [], [], [], []
        ends, at, from_a, from_b, groups = dict(zip(np.cumsum([len(x) for x in raw_a]).tolist(), range(len(a)))), 0, 0, 0, []
        for k, x in enumerate(raw_b):
            at += len(x)
            if at in ends:
                groups.append((a[from_a : ends[at] + 1], b[from_b : k + 1]))
                from_a, from_b = ends[at] + 1, k + 1
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        each.append((i, a, b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (i, len(a), len(b), len(g), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if a else "")
        for i, a, b, g, links in each
    ], counts


def test_alignment(spark):
    texts = TEXTS + list(fuzzed(150, 8))
    rows = [*enumerate(texts), (None, "no id here"), (3, "a repeated row"), (3, "a repeated row")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("links", "n_a", "pair", "end", "doc")})
    got = alignment.align_corpus(docs, *PATHS)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want, counts = plain_alignment(rows)
    key = lambda r: (r[0] is not None, *r[1:], r[0] or 0)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want, key=key)
    own = alignment.load(*PATHS)
    assert {divmod(r["pair"], own.size): r["n"] for r in alignment.pair_counts(got).collect()} == counts
    assert all(own.a.entries[a].endswith(own.b.entries[b]) or own.b.entries[b].endswith(own.a.entries[a]) for a, b in counts) and len(counts) < own.pair_bound()
    assert alignment.align_corpus(docs.limit(0), *PATHS).count() == 0


@pytest.mark.parametrize("links", [1 << 20, 5])
def test_links_of_several_batches_add_up(spark, monkeypatch, links):
    monkeypatch.setattr(alignment, "LINKS", links)
    rows = [(i, f"again and again the same words {i % 3}") for i in range(60)]
    got = alignment.align_corpus(spark.createDataFrame(rows, SCHEMA).repartition(5), *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(plain_alignment(rows)[0])


def plain_grams(texts):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up)) for t in texts]
    return [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []) for w in words]


def joined(spark, ids, texts):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_sets(spark.createDataFrame(list(zip(ids, texts)), SCHEMA)).collect()}


def expected(ids, texts):
    sets = plain_grams(texts)
    top = plain_components(ids, sets)
    return {i: (len(s), top[i]) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("length", [8, 25, 120, 700])
def test_ngram_join_near_the_threshold(spark, length):
    """Copies edited in 1 to some places, so that likeness falls on both sides of 0.85, with sizes across bands."""
    draw = np.random.default_rng(length)
    texts = []
    for n in range(12):
        base = draw.choice([f"w{i}" for i in range(900)], length + 3 * n).tolist()
        texts.append(" ".join(base))
        for _ in range(8):
            words = list(base)
            for at in draw.integers(len(words), size=int(draw.integers(1, 2 + length // 20))):
                words[at] = "Edit" if draw.random() < 0.5 else "x y"
            texts.append(" ".join(words[: len(words) - int(draw.integers(0, 1 + length // 12))]))
    texts += texts[:6] + ["", None, "  ", "SHORT text", "short TEXT", "short texts"]
    ids = draw.permutation(len(texts)).tolist()
    assert joined(spark, ids, texts) == expected(ids, texts)


@pytest.mark.parametrize("small", [True, False])
def test_ngram_join_of_common_passages(spark, monkeypatch, small):
    """A passage that all share without links, a hub with many copies, and two large groups that are near each other."""
    if small:
        monkeypatch.setattr(ngram_join, "BLOCK", 16)
        monkeypatch.setattr(ngram_join, "TEXTS", 3)
        monkeypatch.setattr(ngram_join, "SPLIT", 4)
        monkeypatch.setattr(ngram_join, "HELD", 20)
    draw = np.random.default_rng(7)
    base = [f"b{i}" for i in range(90)]
    texts = [" ".join(base + [f"x{i}y{k}" for k in range(30)]) for i in range(80)]
    core = [f"c{i}" for i in range(300)]
    texts += [" ".join(core[:260] + [f"p{k}" for k in range(40)] + [f"i{i}"]) for i in range(40)]
    texts += [" ".join(core[:260] + [f"q{k}" for k in range(40)] + [f"i{i}"]) for i in range(40)]
    texts += [texts[0] + f" end{i}" for i in range(20)] + ["a common line of few words"] * 30
    ids = draw.permutation(len(texts)).tolist()
    assert joined(spark, ids, texts) == expected(ids, texts)


def test_ngram_join_of_a_large_near_group(spark, monkeypatch):
    """Copies with 0 to 3 edits, few of them near each other, join by their hubs; the blocks have few links left to find."""
    real, left = ngram_join._across, []

    def across(full, joined, texts):
        found = real(full, joined, texts)
        left.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_across", across)
    for n in (150, 300):
        draw = np.random.default_rng(13)
        base, texts = [f"w{i}" for i in range(150)], []
        for i in range(n):
            words = list(base)
            for at in draw.choice(150, int(draw.choice(4, p=[0.02, 0.18, 0.4, 0.4])), replace=False):
                words[at] = f"e{i}x{at}"
            texts.append(" ".join(words))
        ids = draw.permutation(n).tolist()
        assert joined(spark, ids, texts) == expected(ids, texts)
        assert left[-1] <= n


def test_ngram_join_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, "a row of its own here"), (3, "a row of its own here"), (20, "A row of its own here")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "key", "h", "n_shingles", "component")})
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"]) for r in ngram_join.join_sets(docs).collect()), key=str)
    assert len(got) == len(rows) and (-1, None) in got and got.count((3, 3)) == 3
    assert {c for i, c in got if i in (0, 9)} == {0} and (20, 3) in got
    assert ngram_join.join_sets(docs.limit(0)).count() == 0


def test_units_meet_where_sets_are_linked():
    """Any two sets within the bound share a key among those that the larger one may not spare, whichever units it spares."""
    draw = np.random.default_rng(2)
    for n in (6, 7, 9, 15, 40, 200, 1500):
        for _ in range(30):
            a = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
            apart = ngram_join.most_apart(2 * len(a))
            gone = int(draw.integers(0, apart + 1))
            b = np.unique(np.concatenate([a[gone:], draw.integers(0, 1 << 64, int(draw.integers(0, apart - gone + 1)), dtype=np.uint64)]))
            large, small = (a, b) if len(a) >= len(b) else (b, a)
            if not ngram_join.linked(a, b) or np.array_equal(a, b):
                continue
            assert ngram_join.apart(len(a), ngram_join.sketch(a), len(b), ngram_join.sketch(b)) is not None
            met = False
            for band, guest, spare in ngram_join.roles(len(large)):
                if (band, False) not in {r[:2] for r in ngram_join.roles(len(small))}:
                    continue
                keys, segments, left, may = ngram_join.units(large, band)
                both = list(dict.fromkeys(zip(segments[may].tolist(), left[may].tolist())))
                spared = {both[i] for i in draw.permutation(len(both))[:spare]}
                own = {int(k): bool(x) for k, s, x in zip(keys, segments, left) if (int(s), bool(x)) not in spared}
                other = ngram_join.units(small, band)
                met |= any(int(k) in own and not (own[int(k)] and x) for k, x in zip(other[0], other[2]))
            assert met, (n, len(a), len(b))


def plain_negatives(rows):
    of = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        of.setdefault(i, []).append(([int(np.floor(256 * float(x))) for x in v], label))
    known = {i: (min(x)[0], (min(x)[1] + 1) % 10 if i % 7 == 0 else min(x)[1]) for i, x in of.items()}
    out = []
    for a, (v, label) in known.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (w, _) in known.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if known[i][1] == label][:5]:
            fits = [i for i in ranked if known[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sample", [2048, 40, 0])
@pytest.mark.parametrize("kind", ["groups", "lengths", "ties"])
def test_hard_negatives(spark, monkeypatch, kind, sample):
    monkeypatch.setattr(hard_negatives, "SAMPLE", max(1, sample))
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "ASKED", 3)
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((8, 6))
    x = centres[draw.integers(8, size=700)] + 0.3 * draw.standard_normal((700, 6))
    if kind == "lengths":
        x = x * np.exp(draw.normal(0, 1.5, 700))[:, None]
    if kind == "ties":
        x = np.sign(np.round(x)) / 4
    rows = [(i, [float(np.float32(c)) for c in v], int(draw.integers(10))) for i, v in enumerate(x)]
    rows += [(1100, [0.0] * 6, 3), (1200, None, 1), (1300, [1.0] * 6, None), (1400, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1500, [float("nan")] * 6, 1), (1600, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), rows[5], rows[200]]
    vectors = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("length", "bucket", "v", "rank")})
    got = [tuple(r) for r in hard_negatives.mine(vectors).collect()]
    assert sorted(got) == plain_negatives(rows) and got


def test_hard_negatives_of_small_and_large_numbers(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], VECTORS)).count() == 0
    rows = [(100, [400000.0, 3.0], 1), (1, [300000.0, 1.0], 1), (2, [200000.0, 9.0], 2), (3, [299999.0, 1.0], 2)]
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()]
    assert got == plain_negatives(rows) and len(got) == 1
    huge = spark.createDataFrame([(100, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [1e38, 1.0], 2)], VECTORS)
    assert hard_negatives.mine(huge).count() == 0  # as large as 2**27 each, so no score lies under 0.9 times the positive's


def test_coordinate_ranges_miss_nothing():
    draw = np.random.default_rng(4)
    x = draw.integers(-300, 300, (400, 8)) * draw.integers(1, 4, (400, 1))
    block = hard_negatives.Block(x)
    pruned = 0
    for q in draw.integers(-300, 300, (60, 8)):
        score = hard_negatives.scores(q[None], x)[0]
        for least in np.quantile(score, (0.5, 0.9, 0.99, 1.0)):
            at = block.candidates(q, float(least))
            at = np.arange(len(x)) if at is None else at
            assert set(np.flatnonzero(score >= least)) <= set(at.tolist())
            pruned += len(x) - len(at)
    assert pruned > 0
