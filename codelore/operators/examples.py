"""Building examples: variables of both sides, lined up by location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VARIABLE = "struct<t:string,n:string,u:boolean>"
SIDE = f"struct<n:string,c:string,a:map<string,array<{VARIABLE}>>,l:map<string,array<{VARIABLE}>>>"


def flatten_variables(functions: DataFrame) -> DataFrame:
    """A row a variable of functions(bin, func, b, c): both sides, arguments and locals, in one pass."""
    maps = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.map_entries(F.col(side)[kind]).alias("at")) for side in "bc" for kind in "al"))
    each = functions.select("bin", "func", F.inline(maps)).select("bin", "func", "side", "kind", F.inline("at").alias("loc", "vars"))
    return each.select("bin", "func", "side", "kind", "loc", F.explode("vars").alias("v")).select("bin", "func", "side", "kind", "loc", F.col("v.n").alias("name"), F.col("v.t").alias("type_str"), F.col("v.u").alias("user"))


def parse_location(loc: Column) -> tuple[Column, Column]:
    """Kind and number: what starts with s is on the stack, anything else a register."""
    return F.when(loc.startswith("s"), "stack").otherwise("register"), F.substring(loc, F.lit(2), F.char_length(loc)).try_cast("long")


def merge_args_over_locals(variables: DataFrame) -> DataFrame:
    """One kind a location: the argument where both are."""
    first = F.rank().over(Window.partitionBy("func", "loc").orderBy(F.when(F.col("kind") == "a", 0).otherwise(1)))
    return variables.withColumn("_r", first).where("_r = 1").drop("_r")


def drop_shared_locations(variables: DataFrame, name: str = "name") -> DataFrame:
    """Without the locations that hold more than one variable."""
    return variables.withColumn("_n", F.size(F.collect_set(name).over(Window.partitionBy("func", "loc")))).where("_n = 1").drop("_n")


def keep_mentioned(variables: DataFrame, tokens: DataFrame) -> DataFrame:
    """Variables whose name is among their function's tokens(func, token)."""
    return variables.join(tokens.select("func", F.col("token").alias("name")).distinct(), ["func", "name"], "left_semi")


def keep_target_in_source(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.join(source.select("func", "loc").distinct(), ["func", "loc"], "left_semi")


def fill_disappear(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source location with its target, or with the type and name of one that has none."""
    t = target.select("func", "loc", F.col("name").alias("new_name"), F.col("type_str").alias("tgt_type"))
    return source.join(t, ["func", "loc"], "left").withColumns({"new_name": F.coalesce("new_name", F.lit("")), "tgt_type": F.coalesce("tgt_type", F.lit("disappear"))})


def valid_functions(source: DataFrame, target: DataFrame, variables: DataFrame) -> DataFrame:
    """Functions with one name on both sides and a source variable."""
    same = source.select("func", "func_name").join(target.select("func", "func_name"), ["func", "func_name"], "left_semi")
    return same.join(variables.select("func").distinct(), "func", "left_semi")


def legacy_valid(variables: DataFrame, sizes: DataFrame, largest: int = 300, filtering: bool = True) -> DataFrame:
    """Functions under the tree size with a variable and a changed name; all with a variable if not filtering."""
    each = variables.groupBy("func").agg(F.bool_or(F.col("old_name") != F.col("new_name")).alias("changed")).join(sizes, "func")
    return (each.where((F.col("size") < largest) & F.col("changed")) if filtering else each).select("func")


def collect_locations(variables: DataFrame) -> DataFrame:
    """Locations of (func, name, type_str, stkoff, delta, frame, register); unnamed and untyped ones are skipped, a
    register wins over a stack slot."""
    kept = variables.where(F.col("name").isNotNull() & (F.col("name") != "") & F.col("type_str").isNotNull())
    stack = F.col("frame") - (F.col("stkoff") - F.col("delta"))
    return kept.withColumn("loc", F.when(F.col("register").isNotNull(), F.concat(F.lit("r"), "register")).otherwise(F.concat(F.lit("s"), stack)))


def pair_debug_decompiled(debug: DataFrame, decompiled: DataFrame) -> DataFrame:
    return debug.join(decompiled, ["bin", "ea"])


def has_user_names(variables: DataFrame) -> DataFrame:
    return variables.groupBy("func").agg(F.bool_or("user").alias("has_user_names"))


def locations(variables: DataFrame) -> DataFrame:
    return variables.select("func", "loc").distinct()


def variable_name_map(variables: DataFrame) -> DataFrame:
    """Old to new name of each function, the first occurrence of an old name counts."""
    return variables.groupBy("func", "old_name").agg(F.min_by("new_name", "pos").alias("new_name"), F.min("pos").alias("pos"))


EXAMPLE = "name string, code_tokens array<string>, source map<string,struct<n:string,t:string>>, target map<string,struct<n:string,t:string>>, test_meta struct<function_name_in_train:boolean,function_body_in_train:boolean>, binary string"


def to_example(rows: DataFrame) -> DataFrame:
    """The persisted fields as one JSON line."""
    return rows.select(F.to_json(F.struct("name", "code_tokens", "source", "target", "test_meta", "binary")).alias("json"))


def from_example(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("json", EXAMPLE).alias("x")).select("x.*")
