"""The type library: frequencies by size and type, and the search of memory layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelore.functions import ctypes as C
from codelore.operators.features import numbered


def build_typelib(variables: DataFrame) -> DataFrame:
    return variables.groupBy("size", "type_str").agg(F.count("*").alias("freq"))


def merge_typelibs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("size", "type_str").agg(F.sum("freq").alias("freq"))


def prune_typelib(typelib: DataFrame, least: int = 5) -> DataFrame:
    return typelib.where(F.col("freq") >= least)


def rank_typelib(typelib: DataFrame) -> DataFrame:
    order = Window.partitionBy("size").orderBy(F.desc("freq"), "type_str")
    return typelib.withColumn("rank", F.row_number().over(order).cast("long"))


def size_frequency(typelib: DataFrame) -> DataFrame:
    return typelib.groupBy("size").agg(F.sum("freq").alias("freq"))


def type_frequency(asked: DataFrame, typelib: DataFrame) -> DataFrame:
    return asked.join(typelib, ["size", "type_str"], "left")


def sizes(typelib: DataFrame) -> DataFrame:
    return typelib.select("size").distinct()


def types_of_size(typelib: DataFrame, size: int) -> DataFrame:
    return typelib.where(F.col("size") == size)


def fix_bits(typelib: DataFrame) -> DataFrame:
    """Struct fields from bits to bytes; structs with a size that isn't whole are dropped, equal types merged.

    Takes and gives (type, freq), with the new size.
    """
    x = F.col("type")
    whole = F.forall(F.filter(x["l"], lambda p: p["tag"] == C.FIELD), lambda p: p["s"] % 8 == 0)
    fields = F.transform(x["l"], lambda p: F.struct(p["tag"].alias("tag"), p["n"].alias("n"), p["t"].alias("t"), F.when(p["tag"] == C.FIELD, F.floor(p["s"] / 8)).otherwise(p["s"]).cast("long").alias("s")))
    fixed = typelib.where((x["tag"] != C.STRUCT) | whole).withColumn("type", F.when(x["tag"] == C.STRUCT, x.withField("l", fields)).otherwise(x))
    keyed = fixed.select("type", "freq", C.type_key(F.col("type")).alias("key"), C.type_size(F.col("type")).alias("size"))
    return keyed.groupBy("size", "key").agg(F.sum("freq").alias("freq"), F.min(C.type_string(F.col("type"))).alias("type_str"))


def layouts(types: DataFrame) -> DataFrame:
    """name, size, accessible, inaccessible and starts of (name, type); the parts of a struct are placed once."""
    x, p = F.col("type"), F.col("_parts")
    rows = types.select("name", "type", C.placed(x["l"]).alias("_parts"))
    return rows.select("name", C.type_size(x).alias("size"), C.accessible_offsets(x, p).alias("accessible"), C.inaccessible_offsets(x, p).alias("inaccessible"), C.start_offsets(x, p).alias("starts"))


def layout_index(types: DataFrame, largest: int = 1024) -> DataFrame:
    """``layout_id, accessible, starts, size`` of the distinct layouts, numbered in order; larger ones are left out.

    Which types have a layout stands in ``layout_names`` alone, so that what matches a layout carries a number.
    """
    return index_of(layouts(types), largest)


def index_of(rows: DataFrame, largest: int = 1024, *more: Column) -> DataFrame:
    """The index of layouts (size, accessible, starts), and what else is asked of the rows that share one."""
    kept = rows.where(F.col("size") <= largest)
    return numbered(kept.groupBy("accessible", "starts").agg(F.min("size").alias("size"), *more), "accessible", "starts", into="layout_id")


def layout_names(types: DataFrame, index: DataFrame) -> DataFrame:
    """``layout_id, name``, a row a name of each layout."""
    return layouts(types).join(index.select("layout_id", "accessible", "starts"), ["accessible", "starts"]).select("layout_id", "name").distinct()


def next_replacements(stack: DataFrame, index: DataFrame, typelib_sizes: DataFrame) -> DataFrame:
    """``id, cut, layout_id, rest_accessible, rest_starts``: for each layout (id, accessible, starts) and library size that
    cuts it at a legal place, the layout of just that part, null if no type has it, and what remains.

    Nothing unless the first accessible byte is the first start.  Each distinct layout is cut once, whatever the number of
    ids that share it, and goes back to them with all its cuts in one row.  Further columns of the index come along.
    """
    found = replacements_of(stack.select("accessible", "starts"), index, typelib_sizes)
    return stack.select("id", "accessible", "starts").join(found, ["accessible", "starts"]).select("id", F.inline("cuts"))


def replacements_of(layouts_: DataFrame, index: DataFrame, typelib_sizes: DataFrame) -> DataFrame:
    """``accessible, starts, cuts``: the distinct layouts that have legal cuts, and those of ``next_replacements`` as a list.

    Sizes come as one row to all layouts: those that can cut are no more than the longest layout has bytes.
    """
    first, last = F.element_at("accessible", 1), F.element_at("accessible", -1)
    span = layouts_.where((F.size("accessible") > 0) & (F.size("starts") > 0)).where(F.element_at("accessible", 1) == F.element_at("starts", 1)).distinct()
    longest = span.agg(F.max(last - first + 1).alias("_longest"))
    fit = typelib_sizes.select(F.col("size").cast("long").alias("size")).distinct().join(F.broadcast(longest), (F.col("size") > 0) & (F.col("size") <= F.col("_longest")))
    sizes_ = fit.agg(F.collect_set("size").alias("_sizes"))
    # Names of their own: inside a lambda a name would mean the new column of the same name.
    cut = span.crossJoin(F.broadcast(sizes_)).select("accessible", "starts", first.alias("_first"), F.explode(F.filter("_sizes", lambda z: z <= last - first + 1)).alias("cut"))
    cut = cut.withColumn("_at", F.col("_first") + F.col("cut"))
    inner = lambda c: F.transform(F.filter(c, lambda b: b < F.col("_at")), lambda b: b - F.col("_first"))
    rest = lambda c: F.filter(c, lambda b: b >= F.col("_at"))
    whole = cut.withColumns({"rest_accessible": rest("accessible"), "rest_starts": rest("starts")})
    none, some = F.size("rest_starts") == 0, F.size("rest_starts") > 0
    legal = whole.where((none & (F.size("rest_accessible") == 0)) | (some & (F.get("rest_accessible", F.lit(0)) == F.get("rest_starts", F.lit(0)))))
    parts = legal.select(F.struct("accessible", "starts").alias("_of"), "cut", inner("accessible").alias("_a"), inner("starts").alias("_s"), "rest_accessible", "rest_starts")
    # A part that many layouts begin with is looked up once.
    asked = parts.select(F.col("_a").alias("accessible"), F.col("_s").alias("starts")).distinct()
    more = [c for c in index.columns if c not in ("layout_id", "accessible", "starts", "size")]
    known = asked.join(index.select("accessible", "starts", F.struct("layout_id", *more).alias("_found")), ["accessible", "starts"])
    known = known.withColumnsRenamed({"accessible": "_a", "starts": "_s"})
    each = parts.join(known, ["_a", "_s"], "left")
    row = F.struct("cut", *(F.col("_found")[c].alias(c) for c in ("layout_id",)), "rest_accessible", "rest_starts", *(F.col("_found")[c].alias(c) for c in more))
    return each.groupBy("_of").agg(F.collect_list(row).alias("cuts")).select("_of.accessible", "_of.starts", "cuts")


def valid_layout(stack: DataFrame, wanted: DataFrame, index: DataFrame, names: DataFrame, lib: DataFrame) -> DataFrame:
    """Whether the types of wanted(id, names) can be taken in turn from each layout; bytes left over are allowed.

    ``names`` has a row a (layout_id, name).  One join a place of the longest list; a place that several cuts fit takes the
    smallest one.  Layouts and lists that many ids share are tried once.
    """
    from codelore.operators.lineage import cut

    longest = wanted.agg(F.max(F.size("names"))).first()[0] or 0
    every = stack.select("id", "accessible", "starts").join(wanted.select("id", "names"), "id")
    tried = ["accessible", "starts", "names"]
    state = asked_ = numbered(every.select(*tried).distinct(), *tried, into="id")
    done = state.where(F.size("names") == 0).select("id")
    for k in range(longest):
        open_ = state.where(F.size("names") > k).select("id", "accessible", "starts", "names")
        step = next_replacements(open_.select("id", "accessible", "starts"), index, lib.select("size").distinct()).where("layout_id is not null")
        asked = step.join(open_.select("id", "names", F.get("names", F.lit(k)).alias("name")), "id")
        hit = asked.join(names.select("layout_id", "name"), ["layout_id", "name"], "left_semi")
        state = hit.groupBy("id").agg(F.min_by(F.struct("rest_accessible", "rest_starts", "names"), "cut").alias("x")).select("id", F.col("x.rest_accessible").alias("accessible"), F.col("x.rest_starts").alias("starts"), F.col("x.names").alias("names"))
        state = cut(state) if k + 1 < longest else state
        done = done.union(state.where(F.size("names") == k + 1).select("id"))
    good = every.join(asked_.join(done.distinct(), "id").select(*tried), tried, "left_semi").select("id").distinct().withColumn("valid", F.lit(True))
    return wanted.select("id").join(good, "id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


SHAPE = ["size", "accessible", "inaccessible", "starts"]


def layout_classes(rows: DataFrame) -> DataFrame:
    """Distinct shapes of layouts with the number of names that have each and the first of them."""
    return rows.groupBy(*SHAPE).agg(F.count("*").alias("n"), F.min("name").alias("first"))


def replaceable_classes(one: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of classes, the second one's starts, number and first name as ``other_starts``, ``other_n`` and ``other_first``.

    Equal size, accessible and inaccessible bytes, and starts within the other's: the join grows with the number of distinct
    shapes, whatever the number of types that share one.
    """
    b = others.select("size", "accessible", "inaccessible", *(F.col(c).alias(f"other_{c}") for c in ("starts", "n", "first")))
    return one.join(b, SHAPE[:3]).where(F.size(F.array_except("starts", "other_starts")) == 0)


def replaceable_counts(one: DataFrame, others: DataFrame) -> DataFrame:
    """``name, n, first``: how many of the other layouts can stand for each, and the first of their names."""
    from codelore.operators.lineage import cut

    classes = cut(layout_classes(one))
    pairs = replaceable_classes(classes, classes if others is one else layout_classes(others))
    sums = pairs.groupBy(*SHAPE).agg(F.sum("other_n").alias("n"), F.min("other_first").alias("first"))
    return one.join(sums, SHAPE).select("name", "n", "first")


def replaceable_with(one: DataFrame, others: DataFrame) -> DataFrame:
    """Every pair (name, other) of layouts of which the second can stand for the first; as many rows as there are pairs."""
    pairs = replaceable_classes(layout_classes(one), layout_classes(others)).select(*SHAPE, "other_starts")
    named = one.join(pairs, SHAPE).select("name", "size", "accessible", "inaccessible", F.col("other_starts").alias("starts"))
    return named.join(others.select(F.col("name").alias("other"), *SHAPE), SHAPE).select("name", "other")


def stack_layout(variables: DataFrame) -> DataFrame:
    """Sorted bytes and starts of the stack variables (func, offset, size, accessible, starts), and whether any meet."""
    base = F.col("offset") - F.col("size")
    shift = lambda c: F.transform(c, lambda b: b + base)
    both = variables.select("func", shift("accessible").alias("a"), shift("starts").alias("s"))
    all_ = both.groupBy("func").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("s")).alias("s"))
    a, s = F.array_sort(F.array_distinct("a")), F.array_sort(F.array_distinct("s"))
    return all_.select("func", a.alias("accessible"), s.alias("starts"), ((F.size("a") != F.size(a)) | (F.size("s") != F.size(s))).alias("meets"))


def sequence_offsets(parts: DataFrame) -> DataFrame:
    """Bytes and starts of types laid end to end: parts(id, pos, size, accessible, starts)."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    moved = parts.withColumn("_at", before).select("id", "pos", F.transform("accessible", lambda b: b + F.col("_at")).alias("a"), F.transform("starts", lambda b: b + F.col("_at")).alias("s"))
    order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]))
    return moved.groupBy("id").agg(order("a").alias("accessible"), order("s").alias("starts"))


def insert_padding(members: DataFrame) -> DataFrame:
    """Members (id, offset, size, total) and rows for the gaps before, between and after them."""
    order = Window.partitionBy("id").orderBy("offset")
    until = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(order), F.lit(0))
    gaps = members.withColumn("until", until).where(F.col("offset") > F.col("until")).select("id", F.col("until").alias("offset"), (F.col("offset") - F.col("until")).alias("size"), F.lit(True).alias("padding"))
    last = members.groupBy("id").agg(F.max(F.col("offset") + F.col("size")).alias("offset"), F.max("total").alias("total")).where("offset < total")
    ends = last.select("id", "offset", (F.col("total") - F.col("offset")).alias("size"), F.lit(True).alias("padding"))
    return members.select("id", "offset", "size", F.lit(False).alias("padding")).unionByName(gaps).unionByName(ends)


def union_padding(members: DataFrame) -> DataFrame:
    """Bytes after the largest member of members(id, size, total)."""
    return members.groupBy("id").agg((F.max("total") - F.max("size")).alias("padding"))


#: Rounds of a closure that go one step on; what is deeper goes on in steps of doubled length.
STEPS = 5


def type_closure(types: DataFrame, references: DataFrame) -> DataFrame:
    """Types (name) and all that references(name, target) lead to; null targets lead nowhere, circles end.

    A round goes on from what is new, and only that is written.  Few libraries are deeper than some steps; in one that is,
    references are joined with themselves, so that each round doubles the length of the steps that all names
    found take, and a chain of n references ends after log n rounds.
    """
    from codelore.operators.lineage import cut

    edges = references.where("name is not null AND target is not null").select("name", "target").distinct()
    found = [cut(types.select("name").distinct())]
    seen = found[0]

    def fresh(reached: DataFrame) -> DataFrame:
        return cut(reached.select(F.col("target").alias("name")).distinct().join(seen, "name", "left_anti"))

    for _ in range(STEPS):
        found.append(fresh(edges.join(found[-1], "name", "left_semi")))
        if found[-1].isEmpty():
            return seen
        seen = seen.union(found[-1])
    # Names found so far are those within STEPS steps; ``edges`` now takes 2**k steps at once from any name.
    seen, edges = cut(seen), cut(edges)
    while True:
        new = fresh(edges.join(seen, "name", "left_semi"))
        longer = edges.join(edges.select(F.col("name").alias("target"), F.col("target").alias("_to")), "target").select("name", F.col("_to").alias("target"))
        edges = cut(longer.where("name <> target").distinct())
        if new.isEmpty() and fresh(references.where("target is not null").join(seen, "name", "left_semi")).isEmpty():
            return seen
        seen = cut(seen.union(new))


def type_pieces(types: DataFrame) -> DataFrame:
    """Type string and its tokens without the end mark, and the unknown type."""
    x = F.col("type")
    tokens = C.tokenize_type(x)
    rows = types.where(tokens.isNotNull()).select(C.type_string(x).alias("type_str"), F.slice(tokens, F.lit(1), F.size(tokens) - 1).alias("pieces")).distinct()
    return rows.union(types.sparkSession.range(1).select(F.lit("<unk>").alias("type_str"), F.array(F.lit("<unk>")).alias("pieces")))
