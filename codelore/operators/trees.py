"""Trees and graphs: nodes, edges of many kinds, and packed ids."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES = "tree long, node_id long, parent long, role string, opcode string, payload string"


def flatten_ast(trees: DataFrame) -> DataFrame:
    """A row a node of trees(tree, json), walked with a stack; a tree that doesn't parse gives no rows.

    Members x, y and z and the lists of statements, cases and arguments are children by their role; whatever else a
    node holds is its payload.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for tree, text in zip(frame["tree"], frame["json"]):
                try:
                    root = json.loads(text)
                except (TypeError, ValueError):
                    continue
                stack = [(root, None, "root")]
                while stack:
                    node, parent, role = stack.pop()
                    children, rest = [], {}
                    for key, value in node.items():
                        if isinstance(value, dict) and ("M" in value or "node_type" in value):
                            children.append((value, key))
                        elif isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
                            children += [(v, key) for v in value]
                        elif key not in ("id", "M", "node_id", "node_type"):
                            rest[key] = value
                    number = node.get("id", node.get("node_id"))
                    rows.append((tree, number, parent, role, str(node.get("M", node.get("node_type"))), json.dumps(rest, separators=(",", ":"), sort_keys=True)))
                    stack += [(c, number, r) for c, r in reversed(children)]
            yield pd.DataFrame(rows, columns=["tree", "node_id", "parent", "role", "opcode", "payload"]).astype({"parent": "Int64"})

    return trees.select("tree", "json").mapInPandas(walk, NODES)


def parent_child_edges(nodes: DataFrame, both_ways: bool = False) -> DataFrame:
    edges = nodes.where("parent is not null").select("tree", F.col("parent").alias("src"), F.col("node_id").alias("dst"))
    return with_reverse(edges) if both_ways else edges


def subtree_size(nodes: DataFrame) -> DataFrame:
    """``tree, node_id, size``: every row of a node counts for the node and for its ancestors, of which one a level is taken.

    Pointers double: after k rounds a node has counted what lies less than 2**k levels below it, and points 2**k levels up.
    A chain of n nodes takes log n rounds.  Leaves count for their parents first and take no part in the rounds.  A parent that is no node of its tree counts what is below it.  Pointers that are
    still there when they would have passed every node of the largest tree go in a circle, which is an error.
    """
    from codelore.operators.lineage import cut, dealt

    # Of a node a row for itself and one for its parent, which counts nothing but tells what is no leaf.
    none = F.lit(None).cast(nodes.schema["parent"].dataType)
    own = F.struct("node_id", F.lit(1).cast("long").alias("size"), F.col("parent").alias("up"), F.lit(False).alias("inner"))
    above = F.struct(F.col("parent").alias("node_id"), F.lit(0).cast("long").alias("size"), none.alias("up"), F.lit(True).alias("inner"))
    rows = nodes.select("tree", F.inline(F.when(F.col("parent").isNotNull(), F.array(own, above)).otherwise(F.array(own))))
    state = cut(rows.groupBy("tree", "node_id").agg(F.sum("size").alias("size"), F.max("up").alias("up"), F.bool_or("inner").alias("inner")))
    leaves, inner = state.where("not inner"), state.where("inner").select("tree", "node_id", "size", "up")
    many = inner.count()
    lowest = leaves.where("up is not null").groupBy("tree", F.col("up").alias("node_id")).agg(F.sum("size").alias("size")).withColumn("up", none)
    state = cut(dealt(inner.unionByName(lowest), many, "tree", "node_id").groupBy("tree", "node_id").agg(F.sum("size").alias("size"), F.max("up").alias("up")))
    reach, most = 1, None
    while True:
        pointing = state.where("up is not null")
        if pointing.isEmpty():
            return leaves.select("tree", "node_id", "size").unionByName(state.select("tree", "node_id", "size"))
        if reach >= 64 and most is None:  # deep trees only are worth the count
            most = state.groupBy("tree").count().agg(F.max("count")).first()[0]
        if most is not None and reach > most:
            raise ValueError("parents go in a circle")
        sums = pointing.groupBy("tree", F.col("up").alias("_u")).agg(F.sum("size").alias("_below"))
        above = state.select(F.col("tree").alias("_t"), F.col("node_id").alias("_n"), F.col("up").alias("_next"))
        sums = dealt(sums.withColumnRenamed("tree", "_st"), many, "_st", "_u")
        grown = dealt(state, many, "tree", "node_id").join(sums, (F.col("tree") == F.col("_st")) & (F.col("node_id") == F.col("_u")), "left").drop("_st", "_u")
        moved = dealt(grown, many, "tree", "up").join(dealt(above, many, "_t", "_n"), (F.col("tree") == F.col("_t")) & (F.col("up") == F.col("_n")), "left")
        state = cut(moved.select("tree", "node_id", (F.col("size") + F.coalesce("_below", F.lit(0))).alias("size"), F.col("_next").alias("up")))
        reach *= 2


def terminal_nodes(nodes: DataFrame) -> DataFrame:
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node_id")).distinct()
    return nodes.select("tree", "node_id").join(inner, ["tree", "node_id"], "left_anti")


def _chain(rows: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    after = F.lead(node).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("dst", after).where("dst is not null").select("tree", F.col(node).alias("src"), "dst")


def with_reverse(edges: DataFrame) -> DataFrame:
    """Each edge both ways, in one pass over them."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select("tree", F.inline(both))


def terminal_chain(nodes: DataFrame) -> DataFrame:
    """Edges between neighbouring terminals, both ways."""
    return with_reverse(_chain(terminal_nodes(nodes), ["tree"], ["node_id"], "node_id"))


def variable_usage_chain(mentions: DataFrame) -> DataFrame:
    """Edges between neighbouring mentions of a variable, of mentions(tree, variable, ts, node_id)."""
    return _chain(mentions, ["tree", "variable"], ["ts", "node_id"], "node_id")


def root_to_arguments(nodes: DataFrame) -> DataFrame:
    return nodes.where("argument").select("tree", F.lit(0).cast("long").alias("src"), F.col("node_id").alias("dst"))


def master_edges(nodes: DataFrame) -> DataFrame:
    """A virtual node -1 a tree, linked with all its nodes both ways."""
    return with_reverse(nodes.select("tree", F.lit(-1).cast("long").alias("src"), F.col("node_id").alias("dst")))


def variable_master_edges(mentions: DataFrame) -> DataFrame:
    """A virtual node a variable, named by it, linked with its mentions."""
    return mentions.select("tree", F.col("variable").alias("master"), F.col("node_id").alias("dst"))


def pack_graph(nodes: DataFrame, virtual: DataFrame) -> DataFrame:
    """Dense ids over all trees, the nodes first and then the virtual nodes; ids within the group too."""
    from codelore.operators.features import numbered

    both = nodes.select(F.lit(0).alias("kind"), "tree", "node_id").unionByName(virtual.select(F.lit(1).alias("kind"), "tree", "node_id"))
    packed = numbered(both, "kind", "tree", "node_id", into="packed_id")
    first = packed.groupBy("kind").agg(F.min("packed_id").alias("_first"))
    return packed.join(F.broadcast(first), "kind").withColumn("in_group", F.col("packed_id") - F.col("_first")).drop("_first")


def canonicalize_constants(nodes: DataFrame) -> DataFrame:
    """Strings, whole numbers and floats of (opcode, payload) by their kind."""
    kind = F.when(F.col("opcode") == "str", "STRING").when(F.col("opcode") == "num", "NUMBER").when(F.col("opcode") == "fnum", "FLOAT").otherwise(F.col("payload"))
    return nodes.withColumn("payload", kind)


def annotate_arguments(nodes: DataFrame, arguments: DataFrame) -> DataFrame:
    """Whether the variable of a node is among arguments(tree, variable)."""
    known = arguments.select("tree", "variable").distinct().withColumn("argument", F.lit(True))
    return nodes.join(known, ["tree", "variable"], "left").withColumn("argument", F.coalesce("argument", F.lit(False)))


def check_tree(nodes: DataFrame) -> DataFrame:
    """For each tree its size, whether its ids are 0 to size - 1, and how many ids come again."""
    each = nodes.groupBy("tree").agg(F.count("*").alias("size"), (F.max("node_id") + 1).alias("last"), F.count_distinct("node_id").alias("distinct"))
    return each.select("tree", "size", ((F.col("size") == F.col("last")) & (F.col("distinct") == F.col("size"))).alias("good"), (F.col("size") - F.col("distinct")).alias("duplicates"))


def opcode_counts(nodes: DataFrame, names: DataFrame, statements_from: int) -> DataFrame:
    """Nodes by opcode name, split into expressions and statements."""
    kind = F.when(F.col("opcode") >= statements_from, "statement").otherwise("expression")
    return nodes.join(names, "opcode", "left").groupBy("name", kind.alias("kind")).agg(F.count("*").alias("n"))


def tree_fingerprint(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of each tree's nodes in order; trees are equal if theirs are."""
    rows = F.array_sort(F.collect_list(F.struct("node_id", "parent", *columns)))
    return nodes.groupBy("tree").agg(F.sha2(F.to_json(rows), 256).alias("fingerprint"))


def function_identifiers(nodes: DataFrame) -> DataFrame:
    """Names of objects, and the function's name at the root."""
    return nodes.where((F.col("node_type") == "obj") | F.col("parent").isNull()).select("tree", F.col("name").alias("identifier"))


def node_features(nodes: DataFrame, kinds: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of each node's type and name; 0 for a node without a name."""
    a = nodes.join(kinds.select(F.col("word").alias("node_type"), F.col("id").alias("type_id")), "node_type", "left")
    b = a.join(names.select(F.col("word").alias("name"), F.col("id").alias("name_id")), "name", "left")
    return b.select("tree", "node_id", "type_id", F.when(F.col("name").isNull(), 0).otherwise(F.coalesce("name_id", F.lit(3))).alias("name_id"))


def restore_by_tree(packed: DataFrame, terminals: DataFrame) -> DataFrame:
    """Packed ids of each tree's nodes and of its terminals, in order."""
    marked = packed.join(terminals.withColumn("terminal", F.lit(True)), ["tree", "node_id"], "left")
    return marked.groupBy("tree").agg(F.array_sort(F.collect_list("packed_id")).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("terminal"), F.col("packed_id")))).alias("terminals"))
