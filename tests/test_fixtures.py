"""Hand-computed fixtures for code text, types, vocabularies, trees, batches and broken files."""

from __future__ import annotations

import gzip
import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codelore.functions import ctypes as C
from codelore.functions import text as T
from codelore.operators import examples, features, splits, stats, trees, typelib, vocab
from codelore.sources import scans


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("int x; // note\ny = 1;", "int x; \ny = 1;"), ("a /* b */ c", "a \n c"), ("@@VAR_0@@v4@@i = 0LL;", "v4 = 0LL;"), ("", ""), (None, None)],
)
def test_canonical_code(spark, text, want):
    assert one(spark, text, T.canonicalize_code(F.col("v"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [('a->b >>= 0x1F; s = "x\\n";', ["a", "->", "b", ">>=", "Number", ";", "s", "=", "String", ";"]), ('"a" "b" c', ["String", "c"]), ("::g = @@VAR_1@@a1@@p;", ["g", "=", "@@VAR_1@@a1@@p", ";"]), ("", [])],
)
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokenize_code(F.col("v"))) == want


def test_many_literals_take_linear_time(spark):
    rows = spark.createDataFrame([("f(\"x\" y 'c' \"z\"); " * 10_000,), ("@@VAR_0@@a@@b " * 50,), (None,)], "v string")
    began = time.time()
    got = [r["t"] for r in rows.select(T.tokenize_code(F.col("v")).alias("t")).collect()]
    assert got[0] == ["f", "(", "String", "y", "String", ")", ";"] * 10_000 and got[2] is None
    lines = rows.select(T.abstract_lines(F.concat("v", F.lit("\n"))).alias("t")).collect()
    assert len(lines[0]["t"][0]) == 70_000 and time.time() - began < 30


def test_views_of_names(spark):
    tokens = T.tokenize_code(F.col("v"))
    text = "::g = @@VAR_1@@a1@@p;"
    assert one(spark, text, T.name_view(tokens, "SOURCE")) == ["g", "=", "a1", ";"]
    assert one(spark, text, T.name_view(tokens, "TARGET")) == ["g", "=", "p", ";"]
    assert one(spark, text, T.tokenize_code_old_names(F.col("v"))) == ["g", "=", "@@a1@@", ";"]


def test_lines_without_an_end_are_left_out(spark):
    assert one(spark, 'a = "x" "y"; // c\n// only\nlast', T.abstract_lines(F.col("v"))) == [["a", "=", "<LITERAL_STRING>", ";"], ["// only"]]


STRUCT = '{"T":6,"n":"s","l":[{"T":4,"n":"a","t":"int","s":4},{"T":4,"n":"b","t":"char","s":1},{"T":5,"s":3},{"T":4,"n":"c","t":"long","s":8},{"T":4,"n":"d","t":"long","s":8}]}'
UNION = '{"T":7,"n":"u","m":[{"T":4,"n":"i","t":"int","s":4},{"T":4,"n":"c","t":"char","s":1}],"p":{"T":5,"s":4}}'


@pytest.mark.parametrize(
    ("json", "text", "size", "starts", "accessible", "inaccessible", "tokens"),
    [
        ('{"T":1,"n":"int","s":4}', "int", 4, [0], [0, 1, 2, 3], [], ["int", "<eot>"]),
        ('{"T":2,"n":4,"s":4,"t":"int"}', "int[4]", 16, [0, 4, 8, 12], list(range(16)), [], ["<array>", "int", "[4]", "<eot>"]),
        ('{"T":2,"n":0,"s":1,"t":"char"}', "char[]", 0, [], [], [], ["<array>", "char", "[0]", "<eot>"]),
        ('{"T":3,"t":"char"}', "char *", 8, [0], list(range(8)), [], ["<ptr>", "char", "<eot>"]),
        (STRUCT, "struct s { int a; char b; PADDING (3); long c; long d; }", 24, [0, 4, 8, 16], [*range(5), *range(8, 24)], [5, 6, 7], ["<struct>", "s", "int a", "char b", "PADDING (3)", "long c", "long d", "<eot>"]),
        (UNION, "union u { int i; char c; PADDING (4); }", 8, [0], [0, 1, 2, 3], [4, 5, 6, 7], None),
        ('{"T":8}', "void", 0, [0], [], [], ["void", "<eot>"]),
        ('{"T":9,"n":"int (*)(void)"}', "int (*)(void)", 8, [0], list(range(8)), [], ["int (*)(void)", "<eot>"]),
        ('{"T":10}', "disappear", 0, [0], [], [], ["disappear", "<eot>"]),
    ],
)
def test_types(spark, json, text, size, starts, accessible, inaccessible, tokens):
    x = F.col("x")
    row = spark.createDataFrame([(json,)], "j string").select(C.decode_type(F.col("j")).alias("x"))
    got = row.select(C.type_string(x), C.type_size(x), C.start_offsets(x), C.accessible_offsets(x), C.inaccessible_offsets(x), C.tokenize_type(x)).first()
    assert tuple(got) == (text, size, starts, accessible, inaccessible, tokens)
    if tokens:
        assert row.select(C.detokenize_types(C.tokenize_type(x))).first()[0] == [text]
    assert sorted(got[3] + got[4]) == list(range(size))


def layout_tables(spark, rows):
    """The dictionary and the postings of (accessible, starts, size, names)."""
    index = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "layout_id long, accessible array<long>, starts array<long>, size long")
    return index, spark.createDataFrame([(i, n) for i, r in enumerate(rows) for n in r[3]], "layout_id long, name string")


def test_next_replacements(spark):
    index, names = layout_tables(spark, [([0, 1, 2, 3], [0], 4, ["float", "int"]), (list(range(8)), [0], 8, ["char *", "double"])])
    sizes = spark.createDataFrame([(4,), (8,)], "size long")
    stack = spark.createDataFrame([(1, list(range(8)), [0, 4]), (2, list(range(8)), [0]), (3, [1, 2], [2])], "id long, accessible array<long>, starts array<long>")
    got = {(r["id"], r["cut"]): (r["layout_id"], r["rest_accessible"], r["rest_starts"]) for r in typelib.next_replacements(stack, index, sizes).collect()}
    assert got == {(1, 4): (0, [4, 5, 6, 7], [4]), (1, 8): (None, [], []), (2, 8): (1, [], [])}


def test_layout_dictionary(spark):
    structs = ['{"T":1,"n":"int","s":4}', '{"T":1,"n":"float","s":4}', '{"T":3,"t":"char"}', STRUCT, '{"T":1,"n":"huge","s":2000}']
    types = spark.createDataFrame(list(enumerate(structs)), "name long, j string").select("name", C.decode_type(F.col("j")).alias("type"))
    index = typelib.layout_index(types)
    rows = {r["layout_id"]: r["size"] for r in index.collect()}
    assert sorted(rows.values()) == [4, 8, 24] and sorted(rows) == [0, 1, 2]
    of = {}
    for r in typelib.layout_names(types, index).collect():
        of.setdefault(rows[r["layout_id"]], set()).add(r["name"])
    assert of == {4: {0, 1}, 8: {2}, 24: {3}}


def test_replaceable_by_classes(spark):
    draw = random.Random(3)
    rows = []
    for i in range(120):
        size = draw.choice((4, 8))
        rows.append((i, size, list(range(size)), [], sorted({0, *draw.sample(range(size), draw.randint(0, 2))})))
    table = spark.createDataFrame(rows, "name long, size long, accessible array<long>, inaccessible array<long>, starts array<long>")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and set(a[4]) <= set(b[4])}
    assert {tuple(r) for r in typelib.replaceable_with(table, table).collect()} == want
    got = {r["name"]: (r["n"], r["first"]) for r in typelib.replaceable_counts(table, table).collect()}
    assert got == {a: (sum(x == a for x, _ in want), min(y for x, y in want if x == a)) for a in got} and len(got) == 120


def test_closure_of_a_long_chain_and_circles(spark):
    chain = [(f"a{i}", f"a{i + 1}") for i in range(3000)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c1", None), ("a5", "a5"), ("x", "y")]
    refs = spark.createDataFrame(chain, "name string, target string")
    got = {r["name"] for r in typelib.type_closure(spark.createDataFrame([("a0",), ("c1",), ("a0",)], "name string"), refs).collect()}
    assert got == {f"a{i}" for i in range(3001)} | {"c0", "c1", "c2"}
    assert typelib.type_closure(refs.select("name").limit(0), refs).count() == 0


def test_permutation_over_all_rows(spark):
    rows = [(i, i % 7) for i in range(500)]
    got = [tuple(r) for r in stats.shuffled(spark.createDataFrame(rows, "k long, y long").repartition(5), "k", "y", "7").orderBy("k").select("k", "y").collect()]
    drawn = sorted(rows, key=lambda r: hashlib.sha256(f"7:{r[0]}".encode()).hexdigest())
    assert got == [(i, y) for (i, _), (_, y) in zip(rows, drawn)]


def test_vocabulary(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 9), ("c", 7), ("d", 5), ("e", 5), ("f", 1)], "word string, freq long")
    got = {r["word"]: r["id"] for r in vocab.vocab_from_counts(counts, 8, 5).collect()}
    assert got == {"<pad>": 0, "<s>": 1, "</s>": 2, "<unk>": 3, "<IDENTITY>": 4, "a": 5, "b": 6, "c": 7}


def test_memory_codes(spark):
    assert one(spark, ["4", "0", "1024", "1025", "<SEP>"], vocab.encode_memory(F.col("v")), "array<string>") == [7, 3, 1027, 2, 1]


def test_bpe_merges_what_it_learnt(spark):
    words = spark.createDataFrame([("aab", 3), ("aabaab", 2), ("b", 1)], "word string, freq long")
    merges = [(r["left"], r["right"]) for r in vocab.learn_bpe(words, 3).orderBy("rank").collect()]
    assert merges[:2] == [("a", "a"), ("aa", "b")]
    assert vocab.apply_bpe(words, "word", merges[:2]).where("word = 'aabaab'").first()["pieces"] == ["aab", "aab"]
    assert vocab.apply_bpe(spark.createDataFrame([(None,), ("ab",), ("ab",)], "word string"), "word", merges).orderBy("word").collect()[0]["pieces"] == []


def joined(parts, pair):
    out, i = [], 0
    while i < len(parts):
        both = tuple(parts[i : i + 2]) == pair
        out.append("".join(pair) if both else parts[i])
        i += 1 + both
    return out


def one_by_one(counts, merges):
    """Merges learnt one after the other, with the parts that each word has after them."""
    state, want = {w: list(w) for w in counts}, []
    for _ in range(merges):
        pairs = Counter()
        for w, parts in state.items():
            for pair in zip(parts, parts[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        want.append(min(pairs, key=lambda p: (-pairs[p], p)))
        state = {w: joined(parts, want[-1]) for w, parts in state.items()}
    return want, state


@pytest.mark.parametrize(("letters", "most", "merges"), [("abcdef", 50, 90), ("ab", 3, 60)])
def test_merges_are_learnt_as_one_after_the_other(spark, letters, most, merges):
    draw = random.Random(4)
    weights = (8, 5, 3, 2, 1, 1)[: len(letters)]
    counts = {"".join(draw.choices(letters, weights, k=draw.randint(1, 9))): draw.randint(1, most) for _ in range(150)}
    want, _ = one_by_one(counts, merges)
    rows = spark.createDataFrame(list(counts.items()), "word string, freq long")
    assert [(r["left"], r["right"]) for r in vocab.learn_bpe(rows, merges).orderBy("rank").collect()] == want


def test_sure_merges_are_those_of_one_after_the_other():
    """Rounds alone, without a session: many small corpora full of ties and of parts made twice."""
    draw = random.Random(11)
    for _ in range(400):
        counts = {"".join(draw.choices("abc", k=draw.randint(1, 8))): draw.randint(1, 3) for _ in range(12)}
        want, _ = one_by_one(counts, 40)
        found, state = [], {w: list(w) for w in counts}
        while len(found) < len(want):
            pairs = Counter()
            for w, parts in state.items():
                for pair in zip(parts, parts[1:]):
                    pairs[pair] += counts[w]
            ranked = [{"left": p[0], "right": p[1], "n": n} for p, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))]
            for pair in vocab._sure(ranked, {a + b for a, b in found})[: len(want) - len(found)]:
                found.append(pair)
                state = {w: joined(parts, pair) for w, parts in state.items()}
        assert found == want


def test_merged_takes_the_lowest_rank_first():
    draw = random.Random(5)
    for _ in range(300):
        made = ["a", "b", "c"]
        pairs = {}
        for rank in range(12):
            pair = (draw.choice(made), draw.choice(made))
            if pair not in pairs:
                pairs[pair] = rank
                made.append("".join(pair))
        word = "".join(draw.choices("abc", k=draw.randint(0, 30)))
        parts = list(word)
        while open_ := [p for p in zip(parts, parts[1:]) if p in pairs]:
            parts = joined(parts, min(open_, key=pairs.get))
        assert vocab.merged(word, pairs) == parts
    long = "ab" * 100_000
    assert vocab.merged(long, {("a", "b"): 0, ("ab", "ab"): 1}) == ["abab"] * 50_000


def test_marked_tokens_stay_whole_and_pieces_have_ids(spark):
    words = spark.createDataFrame([("x@@aab", 3), ("@@@@aab@@", 2), ("aab@@aab@@aab", 4), ("", 7), (None, 7)], "word string, freq long")
    marked = ["@@", "@@aab@@"]
    merges = vocab.learn_bpe(words, 9, marked)
    assert [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()] == [("a", "a"), ("aa", "b")]
    table = vocab.bpe_vocab(words, merges, marked)
    ids = {r["piece"]: r["id"] for r in table.collect()}
    assert ids == {"<pad>": 0, "<s>": 1, "</s>": 2, "<unk>": 3, "@@": 4, "@@aab@@": 5, "aa": 6, "aab": 7, "a": 8, "b": 9, "x": 10}
    texts = spark.createDataFrame([("aab@@aab@@aab",), ("@@@@aab@@",), ("z<s>@",), ("aab",), ("aab",), ("",), (None,)], "word string")
    got = sorted((r["word"] or "", r["pieces"], r["ids"]) for r in vocab.apply_bpe(texts, "word", merges, marked=marked, vocab=table).collect())
    assert got == [
        ("", [], []), ("", [], []), ("@@@@aab@@", ["@@", "@@aab@@"], [4, 5]), ("aab", ["aab"], [7]), ("aab", ["aab"], [7]),
        ("aab@@aab@@aab", ["aab", "@@aab@@", "aab"], [7, 5, 7]), ("z<s>@", ["z", "<", "s", ">", "@"], [3] * 5),
    ]
    nothing = words.where("false")
    assert vocab.learn_bpe(nothing, 5).count() == 0 and vocab.apply_bpe(texts.where("false"), "word", merges).count() == 0


def test_trees(spark):
    tree = '{"id":0,"M":"block","children":[{"id":1,"M":"expr","x":{"id":2,"M":"asg","x":{"id":3,"M":"var","n":"i"},"y":{"id":4,"M":"num","v":0}}},{"id":5,"M":"return","x":{"id":6,"M":"var","n":"i"}}]}'
    nodes = trees.flatten_ast(spark.createDataFrame([(1, tree), (2, "{"), (3, None)], "tree long, json string"))
    assert {(r["src"], r["dst"]) for r in trees.parent_child_edges(nodes).collect()} == {(0, 1), (1, 2), (2, 3), (2, 4), (0, 5), (5, 6)}
    assert {r["node_id"] for r in trees.terminal_nodes(nodes).collect()} == {3, 4, 6}
    assert {(r["src"], r["dst"]) for r in trees.terminal_chain(nodes).collect()} == {(3, 4), (4, 6), (4, 3), (6, 4)}
    assert {r["node_id"]: r["size"] for r in trees.subtree_size(nodes).collect()}[0] == 7


def test_lined_up_variables(spark):
    source = spark.createDataFrame([("f", "r56", "a1"), ("f", "s16", "v2"), ("f", "s24", "v3"), ("f", "s32", "v4"), ("f", "s32", "v5")], "func string, loc string, name string")
    target = spark.createDataFrame([("f", "r56", "xs", "int *"), ("f", "s16", "total", "int"), ("f", "s99", "x", "int")], "func string, loc string, name string, type_str string")
    kept = examples.drop_shared_locations(source)
    got = {r["loc"]: (r["name"], r["new_name"], r["tgt_type"]) for r in examples.fill_disappear(kept, examples.keep_target_in_source(target, kept)).collect()}
    assert got == {"r56": ("a1", "xs", "int *"), "s16": ("v2", "total", "int"), "s24": ("v3", "", "disappear")}


def test_splits_are_disjoint_and_cover(spark):
    bins = spark.createDataFrame([(f"b{i}",) for i in range(37)], "bin string")
    got = splits.split_by_binary(bins, "1").collect()
    assert len({r["bin"] for r in got}) == 37
    assert sorted(sum(r["split"] == s for r in got) for s in ("test", "dev", "train")) == [3, 3, 31]
    assert {r["split"] for r in splits.split_by_binary(bins.limit(4), "1").collect()} == {"train"}


def test_batches_within_the_budget(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([1, 2, 3, 3, 50, 2])], "bucket long, place long, length long")
    assert [r["batch"] for r in features.token_budget_batches(rows, 9).orderBy("place").collect()] == [0, 0, 0, 1, 2, 3]


def test_numbered_rows(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert features.numbered(rows, "k").where("k <> n").count() == 0


def test_broken_files(spark, tmp_path):
    whole = gzip.compress(b'{"a":1}\n\n{"a":2}\n')
    (tmp_path / "b1_x.jsonl.gz").write_bytes(whole)
    (tmp_path / "b2_x.jsonl.gz").write_bytes(b"no gzip at all")
    lines, broken = scans.skip_corrupt_files(spark, str(tmp_path))
    assert [(r["line_no"], r["json"]) for r in lines.orderBy("line_no").collect()] == [(0, '{"a":1}'), (2, '{"a":2}')]
    assert [r["file"].rpartition("/")[2] for r in broken.collect()] == ["b2_x.jsonl"]
    long = gzip.compress("".join(f'{{"a":{random.Random(i).random()}}}\n' for i in range(20_000)).encode())
    (tmp_path / "b3_x.jsonl.gz").write_bytes(long[:-2000])
    (tmp_path / "b4_x.jsonl.gz").write_bytes(whole + whole)
    (tmp_path / "b5_x.jsonl.gz").write_bytes(b"")
    lines, broken = scans.skip_corrupt_files(spark, str(tmp_path))
    assert sorted(r["file"].rpartition("/")[2] for r in broken.collect()) == ["b2_x.jsonl", "b3_x.jsonl"]
    counts = Counter(r["file"].rpartition("/")[2] for r in lines.collect())
    assert counts["b4_x.jsonl"] == 4 and 1000 < counts["b3_x.jsonl"] < 20_000


def test_deep_trees_and_circles(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(30)] + [(2, 0, None)]
    got = {(r["tree"], r["node_id"]): r["size"] for r in trees.subtree_size(spark.createDataFrame(chain, "tree long, node_id long, parent long")).collect()}
    assert got == {(1, i): 30 - i for i in range(30)} | {(2, 0): 1}
    assert trees.subtree_size(spark.createDataFrame([], "tree long, node_id long, parent long")).count() == 0
    deep = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(10_000)] + [(2, 7, 99), (2, 8, 7)], "tree long, node_id long, parent long")
    got = {(r["tree"], r["node_id"]): r["size"] for r in trees.subtree_size(deep).collect()}
    assert got == {(1, i): 10_000 - i for i in range(10_000)} | {(2, 7): 2, (2, 8): 1, (2, 99): 2}
    with pytest.raises(ValueError, match="circle"):
        trees.subtree_size(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "tree long, node_id long, parent long"))


def test_layouts_against_lists_of_any_length(spark):
    index, named = layout_tables(spark, [(list(range(4)), [0], 4, ["int"]), (list(range(8)), [0], 8, ["long"])])
    cases = [(["int", "int", "long"], True), (["long", "int"], False), ([], True), (["int", "int"], True), (["int", "int", "long", "int"], False), (["int", "long"], False)]
    stack = spark.createDataFrame([(i, list(range(16)), [0, 4, 8]) for i in range(len(cases))], "id long, accessible array<long>, starts array<long>")
    wanted = spark.createDataFrame([(i, names) for i, (names, _) in enumerate(cases)], "id long, names array<string>")
    got = {r["id"]: r["valid"] for r in typelib.valid_layout(stack, wanted, index, named, index.select("size")).collect()}
    assert got == {i: valid for i, (_, valid) in enumerate(cases)}


def test_information_without_chance(spark):
    rows = spark.createDataFrame([(i % 3, i % 4 // 2) for i in range(60)], "x int, y int")
    both, plain = stats.mutual_information(rows, "x", "y").first(), stats.mutual_information(rows, "x", "y", adjusted=False).first()
    assert plain.asDict() == {k: both[k] for k in ("mi", "nmi")}
