"""Tokens, fingerprints, near duplicates and classifiers against plain versions of themselves."""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from codelore.llm import byte_bpe, minhash, piece_counts, quartile_digest, queries, subwords, toxic_spans
from codelore.llm.common import held_out, string_chunks

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "The cat sat on the mat and then the cat sat again.", "", None, "  \n\t ", "éàü 日本語 😀 ￿ mixed  spaces\n\nlines", "word " * 3000, "x" * 5000, "a", "one two three four",
    "The cat sat on the mat and then the cat sat again.", "1234 5678 $$$ ### <s></s> <0x0A>", "İstanbul ŞÜ ﬁ", "\u0000nul\u0001",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, "no id here at all", None, None, 1), (3, "a repeated row", "en", "s0", 14), (3, "a repeated row", "en", "s0", 14)]
    # Columns with names that operators use themselves.
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "predicted", "ids", "key", "label", "size", "kept")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_byte_bpe(docs, empty):
    path = P.path(queries.BPE_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).select("doc_id", "ids", "decoded", "n_tokens").collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect())
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in both)
    assert got == want
    row = byte_bpe.digests(docs, path, P.PATTERN).where("doc_id = 0").first()
    ids = library.encode_ordinary(TEXTS[0])
    assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert byte_bpe.digests(empty, path, P.PATTERN).count() == 0


def test_piece_counts(docs, empty):
    path = P.path(queries.PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = piece_counts.count_tokens(docs, path).collect()
    want = [(r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs.collect()]
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == sorted(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and piece_counts.count_tokens(empty, path).count() == 0


def fuzzed(n, seed):
    """Texts of words, digits, marks, blanks and letters of many scripts, in runs and alone."""
    draw = np.random.default_rng(seed)
    words = ["the", "Token", "ing", "don't", "日本", "語", "Ünïcode", "été", "ß", "\u0301", "😀", "👩‍👩‍👧", "Привет", "مرحبا", "한국어", "<s>", "<0x0A>", "▁", "\u00a0", "\u200b", "\u3000", "ﬁ", "ⅷ", "12", "3.14", "//", "!!!", "\n", "\n\n", "\t", "  ", " ", " ", " ", "aaaa", "xyzzy", "\x01", "|<|"]
    for _ in range(n):
        parts = [words[i] for i in draw.integers(0, len(words), int(draw.integers(0, 40)))]
        parts += ["".join(chr(int(c)) for c in draw.integers(32, 0x2FFF, int(draw.integers(0, 12))))]
        yield "".join(draw.permutation(parts)) if draw.random() < 0.7 else " ".join(draw.permutation(parts))


def test_fuzzed_texts_against_the_libraries(spark):
    """Tokens and counts of 3000 made texts, and of the 200 documents of the smallest table, as the libraries give them."""
    texts = list(fuzzed(3000, 8)) + [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = P.path(queries.BPE_RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = byte_bpe.decode(byte_bpe.encode(rows, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]) == texts[r["doc_id"]].encode() for r in both)
    model = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))
    got = piece_counts.count_tokens(rows, P.path(queries.PIECES)).collect()
    assert len(got) == len(both) == len(texts) and all(r["n_tokens"] == len(model.encode(texts[r["doc_id"]])) for r in got)


def plain_digest(text):
    """A fingerprint by loops: triplets of neighbours and with a skip, 128 buckets, quartiles."""
    raw, m = text.encode(), (1 << 32) - 1
    counts = [0] * 128
    for k, (i, j) in enumerate(((1, 2), (1, 3), (2, 3))):
        for a in range(len(raw) - j):
            h = (raw[a] * 0x9E3779B1 + raw[a + i] * 0x85EBCA77 + raw[a + j] * 0xC2B2AE3D + k * 0x27D4EB2F) & m
            h = (h ^ h >> 15) * 0x2C1B3C6D & m
            counts[h >> 16 & 127] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[31], ranked[63], ranked[95]
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    body = [sum(codes[i + k] << 2 * k for k in range(4)) for i in range(0, 128, 4)]
    return bytes([min(255, int(8 * np.log2(1 + len(raw)))), (15 * q1 // max(q3, 1)) * 16 + 15 * q2 // max(q3, 1), *body])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    steps = {(0, 3): 6, (3, 0): 6}
    pairs = [(x >> s & 3, y >> s & 3) for x, y in zip(a[2:], b[2:]) for s in (0, 2, 4, 6)]
    body = sum(steps.get(p, abs(p[0] - p[1])) for p in pairs)
    ratios = abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    return 1 - min(300, body + 2 * min(abs(a[0] - b[0]), 32) + min(ratios, 16)) / 300


def test_fingerprints_by_loops(spark):
    texts = [t or "" for t in TEXTS] + list(fuzzed(20, 5))
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    assert {r["doc_id"]: r["fingerprint"] for r in quartile_digest.fingerprint(rows).collect()} == {i: plain_digest(t).hex() for i, t in enumerate(texts)}
    for r in quartile_digest.edited_fingerprints(rows).collect():
        own, after = texts[r["doc_id"]], texts[r["doc_id"] - 1]
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        want = plain_digest(own), plain_digest(edited), plain_digest(after)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (want[0].hex(), want[1].hex())
        assert abs(r["near_edited"] - plain_likeness(want[0], want[1])) < 1e-12 and abs(r["near_next"] - plain_likeness(want[0], want[2])) < 1e-12


def test_edited_fingerprints(docs, empty, spark):
    got = {}
    for r in quartile_digest.edited_fingerprints(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    assert sum(map(len, got.values())) == len(order)
    for r, after in zip(order, order[1:] + order[:1]):
        own, following = r["text"] or "", after["text"] or ""
        n = len(own) // 3
        edited = own[: len(own) - n] + following[:n]
        row = next(x for x in got[r["doc_id"]] if x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest())
        assert row["n_chars"] == len(own) and 0 <= row["near_next"] <= 1
        assert (own != following) or (row["near_next"] == 1 and row["near_edited"] <= 1)
        if n == 0:
            assert row["near_edited"] == 1
    assert got[0][0]["fingerprint"] == got[9][0]["fingerprint"]
    alone = quartile_digest.edited_fingerprints(spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    assert quartile_digest.edited_fingerprints(empty).count() == 0


def plain_sets(texts):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    return out


def plain_components(ids, sets):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x):
                one, two = sorted((top(ids[a]), top(ids[b])))
                parent[two] = one
    return {i: top(i) for i in ids}


def test_near_duplicates(spark, docs, empty):
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choice(words, 120)) for _ in range(12)]
    for base in texts[:4]:  # chains of copies, each edited a little from the one before
        for _ in range(14):
            w = base.split()
            w[int(draw.integers(len(w)))] = "Edit"
            base = " ".join(w)
            texts.append(base)
    texts += texts[:6] + ["", "  ", "SHORT text", "short TEXT", "short texts"]
    ids = draw.permutation(len(texts)).tolist()
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(rows).collect()}
    sets = plain_sets(texts)
    want = plain_components(ids, sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in zip(ids, sets))
    odd = minhash.near_duplicates(docs).collect()
    assert len(odd) == docs.count() and {r["component_id"] for r in odd if r["doc_id"] in (0, 9)} == {0}
    assert [r["kept"] for r in odd if r["doc_id"] is None] == [True]
    assert minhash.near_duplicates(empty).count() == 0


def test_rows_of_one_doc_id_with_different_texts(spark):
    """Each text is a document of its own: only what is near another goes, and the same rows on every run."""
    import corpus_pipeline

    draw = np.random.default_rng(5)
    one, two, three, four = (" ".join(draw.choice([f"w{i}" for i in range(400)], 120)) for _ in range(4))
    texts = [(1, one, "s"), (3, two, "s"), (3, one + " edit", "s"), (5, three, "b"), (5, three, "a"), (5, three.upper(), "c"), (5, four, "s"), (5, four + " edit", "s"), (7, four, "s"), (None, two, "s")]
    for order in (texts, texts[::-1]):
        rows = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        got = minhash.near_duplicates(rows).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1), (3, 1), (3, 3), (5, 5), (5, 5), (5, 5), (5, 5), (5, 5), (7, 5)]
        kept = {(r["doc_id"], r["text"].lower().removesuffix(" edit"), r["source"]) for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()}
        assert {k for k in kept if k[0] != 5} == {(1, one, "s"), (3, two, "s"), (None, two, "s")}
        assert {k[1] for k in kept if k[0] == 5} == {three, four} and len(kept) == 5


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["id"]: r["component"] for r in minhash.components(links).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert minhash.components(links.limit(0)).count() == 0


@pytest.mark.parametrize("members", [60, 600])
def test_a_common_bucket_of_unlinked_members(spark, monkeypatch, members):
    """Texts that share 0.6 of their union meet in common buckets without links; the links among them are found all the same."""
    if members < 100:  # many blocks and parts
        monkeypatch.setattr(minhash, "BLOCK", 8)
        monkeypatch.setattr(minhash, "SPLIT", 4)
    draw = np.random.default_rng(6)
    base = [f"b{i}" for i in range(90)]
    texts = [" ".join(base + [f"x{i}y{k}" for k in range(30)]) for i in range(members)]
    texts += [" ".join([*draw.choice([f"c{i}" for i in range(300)], 100), "end"]) for _ in range(5)]
    for i in range(0, 40, 2):  # an edited copy, and one edited from that
        texts += [texts[i] + " more", texts[i] + " more of the same words again and again here now then still on"]
    ids = draw.permutation(len(texts)).tolist()
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    want = plain_components(ids, plain_sets(texts))
    assert got == want and len(set(want.values())) == members + 5


def test_hash_functions_are_alike():
    """Shares of equal minima estimate the likeness of sets of neighbouring numbers too."""
    x = np.arange(1, 401, dtype=np.uint64) << np.uint64(32)
    for shared in (100, 300, 380):
        a, b = x[: 200 + shared // 2], x[200 - shared // 2 :]
        alike = (minhash.signature(a) == minhash.signature(b)).mean()
        assert abs(alike - shared / 400) < 0.15


def test_held_out(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def labelled(spark, good, bad, name, odd):
    rows = [(i, (bad if i % 4 == 0 else good)(i)) for i in range(400)]
    labels = [(i, int((i % 4 == 0) == odd)) for i in range(400)] + [(None, 1), (9999, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {name} int")


def test_quality(spark, docs, empty):
    draw = np.random.default_rng(5)
    vocab = [f"{a}{b}" for a in ("tan", "ber", "sol", "mi") for b in ("ka", "ro", "den", "lis", "po")]
    texts, labels = labelled(spark, lambda i: " ".join(draw.choice(vocab, 40)), lambda i: " ".join(w.upper() + "!!" for w in draw.choice(vocab, 40)), "quality", False)
    model = subwords.fit(texts, labels, "quality")
    rows = subwords.score(texts, model, threshold=0.3).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    odd = subwords.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert subwords.fit(empty, labels.where("false"), "quality").bias == 0 and subwords.score(empty, model).count() == 0


def test_toxic_spans(spark, docs, empty):
    draw = np.random.default_rng(7)
    vocab = [f"{a}{b}" for a in ("tan", "ber", "sol", "mi") for b in ("ka", "ro", "den", "lis", "po")]

    def bad(i):
        w = list(draw.choice(vocab, 40))
        w[7] = "Grubel" + str(draw.choice(["", "ka", "po", "x"])) + ","
        return " ".join(w)

    texts, labels = labelled(spark, lambda i: " ".join(draw.choice(vocab, 40)), bad, "toxic", True)
    field = toxic_spans.fit(texts, labels, "toxic")
    rows = toxic_spans.tag(texts, field).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    hit = next(r for r in rows if r["predicted"])
    assert all("grubel" in hit["text"][s["start"] : s["end"]].lower() for s in hit["spans"])
    odd = toxic_spans.tag(docs, field).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxic_spans.tag(empty, toxic_spans.fit(empty, labels.where("false"))).count() == 0


def rolled(raw, seed):
    """The hash of a byte range by its definition."""
    from codelore.llm.common import Rolling, mixed

    tabled = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64).tolist()
    total = sum(tabled[b] * pow(int(Rolling.STEP), i, 1 << 64) for i, b in enumerate(raw)) % (1 << 64)
    return int(mixed(np.array([total], np.uint64))[0])


def split_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def test_toxic_scores_by_loops(spark):
    """Each text's score is the largest marginal of a word, by forward and backward sums in plain Python."""
    draw = np.random.default_rng(3)
    weights = np.append(draw.normal(size=1 << toxic_spans.BITS) * 2, -3.0).astype(np.float32)
    weights[0] = 0
    step = np.array([[0.9, 0.1], [0.3, 0.7]])
    texts = ["", "One, two; THREE four-five ... é日本!", "a", "!!! x", " ".join(fuzzed(3, 9))]
    rows = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for r in toxic_spans.tag(rows, toxic_spans.Field(weights, step)).collect():
        odds = []
        for raw in split_words(texts[r["doc_id"]]):
            core = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).strip(bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
            buckets = [rolled(core, 5) >> 64 - toxic_spans.BITS] if core else []
            buckets += [(rolled(core[:n], 5) ^ n * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - toxic_spans.BITS for n in toxic_spans.PREFIXES if len(core) >= n]
            odds.append(np.exp(float(weights[-1]) + sum(float(weights[b]) for b in buckets)))
        own = [np.array([1.0, x]) for x in odds]
        forward = [own[0] * step.sum(axis=0)] if own else []
        for x in own[1:]:
            forward.append(x * (forward[-1] @ step))
        backward = [step.sum(axis=1)] if own else []
        for x in own[:0:-1]:
            backward.insert(0, step @ (x * backward[0]))
        marginals = [f[1] * b[1] / (f @ b) for f, b in zip(forward, backward)]
        assert abs(r["score"] - max(marginals, default=0)) < 1e-6


def test_quality_scores_by_loops(spark):
    draw = np.random.default_rng(4)
    model = subwords.Model(draw.normal(size=1 << subwords.BITS), 0.3)
    texts = ["", "one two two THREE", "日本語 é ab", " ".join(fuzzed(3, 6))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in subwords.score(rows, model).collect():
        found, last = [], None
        for raw in split_words(texts[r["doc_id"]]):
            found.append(rolled(raw, 7) >> 64 - subwords.BITS)
            found += [1] if raw == last else []
            last = raw
        whole = texts[r["doc_id"]].encode()
        # A run may begin or end with the blank beside a word.
        found += [(rolled(whole[i : i + n], 7) + n) % (1 << 64) >> 64 - subwords.BITS for n in subwords.GRAMS for i in range(len(whole) - n + 1) if not set(whole[i + 1 : i + n - 1]) & set(b"\x20\t\n\v\f\r")]
        logit = 0.3 + (np.mean([model.weights[b] for b in found]) if found else 0)
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_marginals_by_all_paths():
    draw = np.random.default_rng(1)
    step = np.array([[0.7, 0.3], [0.4, 0.6]])
    for sizes in ([3, 1, 4], [1], [20, 2, 2] + [1] * 30):
        logits = draw.normal(size=sum(sizes))
        got, at = toxic_spans.marginals(logits, np.array(sizes), step), 0
        for n in sizes[:3]:
            if n <= 4:
                total, hits = 0.0, np.zeros(n)
                for path in range(1 << n):
                    tags = [(path >> k) & 1 for k in range(n)]
                    w = np.exp(sum(logits[at + k] * t for k, t in enumerate(tags)))
                    # Before the first word both states are alike.
                    w *= step[0, tags[0]] + step[1, tags[0]]
                    for a, b in zip(tags, tags[1:]):
                        w *= step[a, b]
                    w *= step[tags[-1]].sum()
                    total += w
                    hits += w * np.array(tags)
                assert np.allclose(got[at : at + n], hits / total)
            at += n


def test_shingles_of_chunks():
    import pyarrow as pa

    texts = ["a b c d e f", "", "x y", "a b c d e f"]
    sets = [s for _, chunk in string_chunks(pa.array(texts), 4) for s in minhash.shingle_sets(chunk)]
    together = [s for _, chunk in string_chunks(pa.array(texts)) for s in minhash.shingle_sets(chunk)]
    assert [s.tolist() for s in sets] == [s.tolist() for s in together] and len(sets[0]) == 2 and sets[0].tolist() == sets[3].tolist()


def test_what_fits_bring_to_the_driver(spark, monkeypatch):
    """Toxicity: weights of common features alone, to the driver and to tasks; quality: at most half of 8 bytes a feature."""
    from codelore.llm.common import Texts

    draw = np.random.default_rng(11)
    vocab = [f"{a}{b}" for a in ("tan", "ber", "sol", "mi") for b in ("ka", "ro", "den", "lis", "po")]
    texts, labels = labelled(spark, lambda i: " ".join(draw.choice(vocab, 40)), lambda i: " ".join([*draw.choice(vocab, 39), "grubel"]), "toxic", True)
    field = toxic_spans.fit(texts, labels, "toxic")
    assert len(pickle.dumps(field)) < 100_000 and len(field.weights) == len(field.buckets) + 1
    one, all_ = (toxic_spans.tag(texts, f).select("doc_id", "score").collect() for f in (field, toxic_spans.Field(field.table, field.step)))
    assert sorted(one) == sorted(all_) and len({r["score"] for r in one}) > 2

    came = []
    kind = type(texts)
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): (came.append((self.columns, out := f(self))), out)[1])
    subwords.fit(texts, labels, "toxic")
    sent = sum(len(b) for columns, out in came if "doc_id" in columns for r in (out.to_pylist() if hasattr(out, "to_pylist") else [x.asDict() for x in out]) for b in r.values() if isinstance(b, (bytes, bytearray)))
    sample = subwords.labelled_sample(texts, labels, "toxic", subwords.SAMPLE)[0].select("text").collect()
    found = sum(len(np.unique(subwords.features(Texts(np.frombuffer(r["text"].encode(), np.uint8), np.array([0, len(r["text"].encode())])))[0])) for r in sample)
    assert 0 < sent < 4 * found
