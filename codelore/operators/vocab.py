"""Vocabularies: building them from counts, encoding with them, and subword merges."""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelore.operators.lineage import cut

# Fixed values of the format: the first ids, and the codes of memory and locations.
SPECIALS = ["<pad>", "<s>", "</s>", "<unk>", "<IDENTITY>"]
UNKNOWN, SEPARATOR_CODE, LARGE_CODE, OFFSET_CODE, LARGEST, MEMORY_VALUES, REGISTER_BASE = 3, 1, 2, 3, 1024, 128, 1030


def vocab_from_counts(counts: DataFrame, size: int, cutoff: int, predefined: list[str] | None = None) -> DataFrame:
    """``word, id, freq``: the specials, the predefined words, then words by (-freq, word) while there is room.

    The size counts the specials too.  Only the words that get in are ordered in one place, at most ``size``.
    """
    fixed = [*SPECIALS, *[w for w in dict.fromkeys(predefined or []) if w not in SPECIALS]]
    spark = counts.sparkSession
    head = spark.createDataFrame(list(enumerate(fixed)), "id long, word string").select("word", "id", F.lit(None).cast("long").alias("freq"))
    rest = counts.where((F.col("freq") >= cutoff) & ~F.col("word").isin(fixed)).orderBy(F.desc("freq"), "word").limit(max(0, size - len(fixed)))
    numbered = rest.select("word", (F.row_number().over(Window.orderBy(F.desc("freq"), "word")) + len(fixed) - 1).cast("long").alias("id"), F.col("freq").cast("long"))
    return head.unionByName(numbered)


def count_types(typelib: DataFrame) -> DataFrame:
    return typelib.groupBy(F.col("type_str").alias("word")).agg(F.sum("freq").alias("freq"))


def count_tokens(tokens: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    return tokens.select(F.explode(column).alias("word"), (F.lit(1).cast("long") if weight is None else weight).alias("n")).groupBy("word").agg(F.sum("n").alias("freq"))


def count_names(variables: DataFrame) -> DataFrame:
    return variables.groupBy(F.col("new_name").alias("word")).agg(F.count("*").alias("freq"))


def count_registers(variables: DataFrame) -> DataFrame:
    return variables.where(F.col("loc").startswith("r")).groupBy(F.substring("loc", 2, 20).alias("word")).agg(F.count("*").alias("freq"))


def encode(rows: DataFrame, column: str, vocab: DataFrame, into: str = "id") -> DataFrame:
    """The id of each word, or the unknown id.  Spark broadcasts the vocabulary while its size allows."""
    words = vocab.select(F.col("word").alias(column), F.col("id").alias("_id"))
    return rows.join(words, column, "left").withColumn(into, F.coalesce("_id", F.lit(UNKNOWN))).drop("_id")


def decode(rows: DataFrame, column: str, vocab: DataFrame, into: str = "word") -> DataFrame:
    words = vocab.select(F.col("id").alias(column), F.col("word").alias(into))
    return rows.join(words, column, "left")


def lookup_decompiler_type(rows: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """The id of a type; else, of a struct, that of the text after 'struct '; else the unknown id."""
    whole = encode(rows, column, vocab, "_whole")
    bare = F.when(F.col(column).startswith("struct "), F.substring(column, F.lit(8), F.char_length(column)))
    both = encode(whole.withColumn("_bare", bare), "_bare", vocab, "_of_bare")
    return both.withColumn("id", F.when(F.col("_whole") != UNKNOWN, F.col("_whole")).otherwise(F.col("_of_bare"))).drop("_whole", "_bare", "_of_bare")


def encode_memory(values: Column) -> Column:
    """Codes of the first 128 values, given as strings; the separator, values over 1024, and the others moved up."""
    number = lambda v: v.try_cast("long")
    return F.transform(F.slice(values, 1, MEMORY_VALUES), lambda v: F.when(v == "<SEP>", SEPARATOR_CODE).when(number(v) > LARGEST, LARGE_CODE).otherwise(number(v) + OFFSET_CODE).cast("long"))


def encode_location(variables: DataFrame) -> DataFrame:
    """``code`` of variables(func, loc): registers by number, stack slots by their distance from the function's last."""
    stack = F.col("loc").startswith("s")
    offset = F.substring("loc", 2, 20).cast("long")
    gap = F.max(F.when(stack, offset)).over(Window.partitionBy("func")) - offset
    code = F.when(~stack, REGISTER_BASE + offset).when(gap >= LARGEST, LARGE_CODE).otherwise(OFFSET_CODE + gap)
    return variables.withColumn("code", code)


def layout_vector(code: Column, size: Column, starts: Column) -> Column:
    """The location's code, then the codes of the size and of the start offsets."""
    values = F.transform(F.concat(F.array(size), starts), lambda v: v.cast("string"))
    return F.concat(F.array(code), encode_memory(values))


#: Pairs that a round looks at, merges that it makes, at most, and merges after which the lineage is cut.
BATCH, ROUND, CUT = 512, 32, 48
#: Around each part of a word: code points that stand for no character and are not for interchange.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
#: The first ids of a subword vocabulary, and characters of words that one group of ``apply_bpe`` holds, on average.
PIECE_SPECIALS, GROUP = ["<pad>", "<s>", "</s>", "<unk>"], 1 << 20


def parted(word: Column) -> Column:
    """A word as its characters, each between the marks."""
    return F.array_join(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.concat(F.lit(OPEN), c, F.lit(CLOSE))), "")


def _any_of(marked: Sequence[str]) -> str:
    """A pattern for the marked tokens, of those that begin at one place the longest; nothing without tokens."""
    return "|".join(re.escape(m) for m in sorted(set(marked), key=lambda m: (-len(m), m)) if m)


def unmarked(words: DataFrame, marked: Sequence[str] = ()) -> DataFrame:
    """``word, freq`` of what lies around the marked tokens of words(word, freq), equal parts added up."""
    kept = words.where("word <> ''")
    if _any_of(marked):
        kept = kept.select(F.explode(F.split("word", _any_of(marked))).alias("word"), "freq").where("word <> ''")
    return kept.groupBy("word").agg(F.sum("freq").alias("freq"))


def learn_bpe(words: DataFrame, merges: int, marked: Sequence[str] = ()) -> DataFrame:
    """``rank, left, right`` of the merges learnt from words(word, freq): the commonest pair, then by text.

    Marked tokens stand for themselves: no merge reaches into or across one.  Null and empty words teach nothing.  The
    counts of pairs are a table of their own; a round corrects it by the words that its own merges have changed, takes as
    many merges as are sure, and looks at the next.  Words that are one part drop out when the lineage of the words is cut.
    """
    spark = words.sparkSession
    state = cut(unmarked(words, marked).select(parted(F.col("word")).alias("p"), "freq"))
    counts = cut(pair_counts(state))
    found: list[tuple[str, str]] = []
    made: list[tuple[str, str]] = []  # since the last cut of the words
    sure: list[tuple[str, str]] = []
    while len(found) < merges:
        if sure:
            # Of the words that the last round's merges have changed, the pairs of now for those of then.
            both = F.array(F.struct("p", "freq"), F.struct(F.col("was").alias("p"), (-F.col("freq")).alias("freq")))
            before = _rewritten(state, made[: -len(sure)]).select("p", "freq")
            moved = _rewritten(before, sure).where("p <> was").select(F.inline(both))
            counts = cut(counts.unionByName(pair_counts(moved)).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"))
        if len(made) >= CUT:
            state, made = cut(_rewritten(state, made).select("p", "freq").where(F.col("p").contains(CLOSE + OPEN))), []
        ranked = counts.orderBy(F.desc("n"), "left", "right").limit(BATCH).collect()
        sure = _sure(ranked, {a + b for a, b in found})[: merges - len(found)]
        if not sure:
            break
        found, made = found + sure, made + sure
    return spark.createDataFrame([(k, *pair) for k, pair in enumerate(found)], "rank long, left string, right string")


def _rewritten(state: DataFrame, made: list[tuple[str, str]]) -> DataFrame:
    """``was, p, freq`` of state(p, freq), before and after the merges."""
    if not made:
        return state.select(F.col("p").alias("was"), "p", "freq")
    # Each part has marks of its own, so that a replacement goes on right after the last one.
    after = F.col("p")
    for a, b in made:
        after = F.replace(after, F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}"), F.lit(f"{OPEN}{a}{b}{CLOSE}"))
    # As a row of its own the text is computed once, however often it is looked at.
    return state.select(F.col("p").alias("was"), "freq", F.explode(F.array(after)).alias("p"))


def _sure(ranked: list, made: set[str]) -> list[tuple[str, str]]:
    """The next merges, of pairs in their order, as merging one after the other would choose them.

    Merging (a, b) changes only pairs that end in a or begin with b.  The pairs that it brings about are no commoner than
    the changed ones that they come from, unless ``made`` already holds the part ab.  So the order holds up to the first
    changed pair, or to the first part that was made before; of pairs as common as a changed one, those before
    all that it may turn into.
    """
    taken: list = []
    ends: set[str] = set()
    starts: set[str] = set()
    for r in ranked:
        if r["right"] in ends or r["left"] in starts or len(taken) == ROUND:
            break
        taken.append(r)
        ends.add(r["left"])
        starts.add(r["right"])
        if r["left"] == r["right"] or r["left"] + r["right"] in made:
            break
        made = made | {r["left"] + r["right"]}
    first: dict[int, tuple[str, str]] = {}
    for q in ranked[len(taken) :]:
        if q["right"] in ends or q["left"] in starts:
            lefts = [q["left"], *[t["left"] + t["right"] for t in taken if t["right"] == q["left"]]]
            rights = [q["right"], *[t["left"] + t["right"] for t in taken if t["left"] == q["right"]]]
            first[q["n"]] = min([(x, y) for x in lefts for y in rights] + [p for p in [first.get(q["n"])] if p])
    least = ranked[-1]["n"] if len(ranked) == BATCH else 0
    out: list[tuple[str, str]] = []
    for r in taken:
        pair = (r["left"], r["right"])
        if out and (r["n"] <= least or r["n"] in first and first[r["n"]] < pair):
            break
        out.append(pair)
    return out


def pair_counts(state: DataFrame) -> DataFrame:
    """``left, right, n`` of the adjacent parts of state(p, freq)."""
    parts = state.where(F.col("p") != "").select(F.split(F.substring("p", F.lit(2), F.length("p") - 2), CLOSE + OPEN).alias("p"), "freq").where(F.size("p") > 1)
    pairs = F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("left"), F.slice("p", F.lit(2), F.size("p") - 1).alias("right"))
    return parts.select(F.explode(pairs).alias("x"), "freq").groupBy("x.left", "x.right").agg(F.sum("freq").alias("n"))


def bpe_vocab(words: DataFrame, merges: DataFrame, marked: Sequence[str] = ()) -> DataFrame:
    """``id, piece, kind`` of a subword vocabulary: the specials, the marked tokens, what merges make by rank, and the
    characters of words(word, freq) by (-freq, text).  A piece that several merges make counts once."""
    fixed = [(w, "special") for w in PIECE_SPECIALS] + [(w, "marked") for w in dict.fromkeys(marked) if w]
    head = words.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(fixed)], "id long, piece string, kind string")
    made = merges.groupBy(F.concat("left", "right").alias("piece")).agg(F.min("rank").alias("place")).select("piece", F.lit("merge").alias("kind"), "place")
    chars = unmarked(words, marked).select(F.explode(F.split("word", "")).alias("piece"), "freq").where("piece <> ''").groupBy("piece").agg((-F.sum("freq")).alias("place"))
    rest = made.unionByName(chars.select("piece", F.lit("char").alias("kind"), "place"))
    # As many rows as there are merges and code points.
    number = F.row_number().over(Window.orderBy(F.desc("kind"), "place", "piece")) + len(fixed) - 1
    return head.unionByName(rest.select(number.cast("long").alias("id"), "piece", "kind"))


def apply_bpe(rows: DataFrame, column: str, merges: DataFrame | list[tuple[str, str]], into: str = "pieces", marked: Sequence[str] = (), vocab: DataFrame | None = None) -> DataFrame:
    """The pieces of each word under merges(rank, left, right), the lowest rank first; with ``vocab`` their ``ids`` too.

    Marked tokens are pieces of their own; a piece that the vocabulary lacks has the unknown id; a null or empty word has no
    pieces.  Each distinct word is merged once.  Words are dealt over groups of some millions of characters, and every
    group gets the table of ranks and ids beside its words, which never passes through the driver.
    """
    spark, pattern = rows.sparkSession, _any_of(marked)
    if isinstance(merges, list):
        merges = spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank long, left string, right string")
    words = cut(rows.select(F.col(column).alias("_word")).where("_word <> ''").distinct())
    groups = 1 + (words.agg(F.sum(F.length("_word"))).first()[0] or 0) // GROUP
    dealt = words.withColumn("_group", F.pmod(F.xxhash64("_word"), F.lit(groups)))
    ranks = merges.select("left", "right", F.col("rank").alias("value"))
    if vocab is not None:
        ranks = ranks.unionByName(vocab.where("kind <> 'special'").select(F.col("piece").alias("left"), F.lit(None).cast("string").alias("right"), F.col("id").alias("value")))
    ranks = ranks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("_group"))

    def split(words: pa.Table, ranks: pa.Table) -> pa.Table:
        order, ids = {}, {}
        for left, right, value in sorted(zip(*(ranks[c].to_pylist() for c in ("left", "right", "value"))), key=lambda r: -r[2]):
            if right is None:
                ids[left] = value
            else:
                order[left, right] = value
        whole = re.compile(f"({pattern})") if pattern else None
        pieces, ends = [], [0]
        for w in words["_word"].to_pylist():
            for i, part in enumerate(whole.split(w) if whole else [w]):
                if i % 2:
                    pieces.append(part)
                elif part:
                    pieces += merged(part, order)
            ends.append(len(pieces))
        at = pa.array(ends, pa.int32())
        flat = pa.array(pieces, pa.string()), pa.array([ids.get(p, UNKNOWN) for p in pieces], pa.int64())
        return pa.table([words["_word"], *(pa.ListArray.from_arrays(at, x) for x in flat)], names=["_word", "_pieces", "_ids"])

    found = dealt.groupBy("_group").cogroup(ranks.groupBy("_group")).applyInArrow(split, "_word string, _pieces array<string>, _ids array<long>")
    joined = rows.join(found, F.col(column) == F.col("_word"), "left").withColumn(into, F.coalesce("_pieces", F.array().cast("array<string>")))
    if vocab is not None:
        joined = joined.withColumn("ids", F.coalesce("_ids", F.array().cast("array<long>")))
    return joined.drop("_word", "_pieces", "_ids")


def merged(word: str, order: dict[tuple[str, str], int]) -> list[str]:
    """The parts of a word: again and again all pairs of the lowest rank from the left, by a heap of places."""
    parts = list(word)
    places = [(order[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in order]
    if not places:
        return parts
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heapq.heapify(places)
    while places:
        rank, joined = places[0][0], []
        while places and places[0][0] == rank:
            i = heapq.heappop(places)[1]
            j = after[i]
            if parts[i] is None or j == len(parts) or order.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            joined.append(i)
        for i in joined:
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (parts[x], parts[y]) in order:
                    heapq.heappush(places, (order[parts[x], parts[y]], x))
    return [p for p in parts if p is not None]


def truncate_wrap(pieces: Column, most: int = 510) -> Column:
    return F.concat(F.array(F.lit("<s>")), F.slice(pieces, 1, most), F.array(F.lit("</s>")))


def target_pieces(variables: DataFrame) -> DataFrame:
    """Pieces that spell each variable's new name, the identity for one that stays, with the function's total."""
    pieces = F.when(F.col("old_name") == F.col("new_name"), F.array(F.lit("<IDENTITY>"), F.lit("</s>"))).otherwise(F.concat(F.split("new_name", "_"), F.array(F.lit("</s>"))))
    return variables.withColumn("pieces", pieces).withColumn("total", F.sum(F.size("pieces")).over(Window.partitionBy("func")))


def build_grammar(nodes: DataFrame, types: DataFrame, least: int = 100) -> DataFrame:
    """``kind, word, id`` of the sorted node types, and of the type tokens over ``least`` after the two specials."""
    kinds = nodes.select(F.col("node_type").alias("word")).distinct().withColumn("id", (F.row_number().over(Window.orderBy("word")) - 1).cast("long")).withColumn("kind", F.lit("node"))
    common = types.where(F.col("freq") > least).select("word", (F.row_number().over(Window.orderBy("word")) + 1).cast("long").alias("id"), F.lit("type").alias("kind"))
    special = nodes.sparkSession.createDataFrame([("<pad>", 0, "type"), ("<unk>", 1, "type")], "word string, id long, kind string")
    return kinds.unionByName(common).unionByName(special)


def source_word_counts(variables: DataFrame) -> DataFrame:
    """Old names at every mention, and new names where they differ."""
    old = variables.select(F.col("old_name").alias("word"))
    new = variables.where(F.col("old_name") != F.col("new_name")).select(F.col("new_name").alias("word"))
    return old.unionByName(new).groupBy("word").agg(F.count("*").alias("freq"))
