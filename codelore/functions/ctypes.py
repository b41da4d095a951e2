"""Columns over types of C, held as one struct: T tag, n name, s size, t element or target, l layout, m members, p padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = "struct<tag:int,n:string,t:string,s:bigint>"
TYPE = f"struct<tag:int,n:string,s:bigint,t:string,l:array<{PART}>,m:array<{PART}>,p:{PART}>"
# Fixed values of the encoding: tags and tokens.
SCALAR, ARRAY, POINTER, FIELD, PADDING, STRUCT, UNION, VOID, FUNCTION, DISAPPEAR = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10
END, POINTER_TOKEN, ARRAY_TOKEN, STRUCT_TOKEN = "<eot>", "<ptr>", "<array>", "<struct>"


def decode_type(json: Column) -> Column:
    # Field names of Spark differ by more than case.
    return F.from_json(F.replace(json, F.lit(chr(34) + "T" + chr(34)), F.lit(chr(34) + "tag" + chr(34))), TYPE)


def _part_string(p: Column) -> Column:
    return F.when(p["tag"] == PADDING, F.concat(F.lit("PADDING ("), p["s"], F.lit(")"))).otherwise(F.concat(p["t"], F.lit(" "), p["n"]))


def _count(x: Column) -> Column:
    return x["n"].cast("long")


def _union_parts(x: Column) -> Column:
    return F.concat(x["m"], F.when(x["p"].isNotNull(), F.array(x["p"])).otherwise(F.slice(x["m"], 1, 0)))


def type_string(x: Column) -> Column:
    body = lambda parts: F.array_join(F.transform(parts, _part_string), "; ")
    tag = x["tag"]
    return (
        F.when(tag.isin(SCALAR, FUNCTION), x["n"])
        .when(tag == ARRAY, F.concat(x["t"], F.lit("["), F.when(_count(x) == 0, "").otherwise(x["n"]), F.lit("]")))
        .when(tag == POINTER, F.concat(x["t"], F.lit(" *")))
        .when(tag.isin(FIELD, PADDING), _part_string(x))
        .when(tag == STRUCT, F.concat(F.lit("struct "), x["n"], F.lit(" { "), body(x["l"]), F.lit("; }")))
        .when(tag == UNION, F.concat(F.lit("union "), x["n"], F.lit(" { "), body(_union_parts(x)), F.lit("; }")))
        .when(tag == VOID, "void")
        .when(tag == DISAPPEAR, "disappear")
    )


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["s"])


def _largest(members: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(members, lambda p: p["s"])), F.lit(0)).cast("long")


def type_size(x: Column) -> Column:
    tag = x["tag"]
    return (
        F.when(tag.isin(SCALAR, FIELD, PADDING), x["s"])
        .when(tag == ARRAY, _count(x) * x["s"])
        .when(tag.isin(POINTER, FUNCTION), F.lit(8).cast("long"))
        .when(tag == STRUCT, _sum(x["l"]))
        .when(tag == UNION, _largest(x["m"]) + F.coalesce(x["p"]["s"], F.lit(0)))
        .otherwise(F.lit(0).cast("long"))
    )


def _range(first: Column, size: Column) -> Column:
    """first, first + 1, ..., of so many; a sequence to less than its start would count down."""
    return F.when(size > 0, F.sequence(first, first + size - 1)).otherwise(F.array().cast("array<bigint>"))



def placed(parts: Column) -> Column:
    """Parts with the offset at which each starts."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,tag:int,s:bigint>>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + p["s"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p["tag"].alias("tag"), p["s"].alias("s")))).alias("out"))
    return F.aggregate(parts, start, step, lambda a: a["out"])


def _bytes_of(x: Column, padding: bool, parts: Column | None = None) -> Column:
    chosen = F.filter(placed(x["l"]) if parts is None else parts, lambda p: (p["tag"] == PADDING) if padding else (p["tag"] != PADDING))
    return F.flatten(F.transform(chosen, lambda p: _range(p["at"], p["s"])))


def accessible_offsets(x: Column, parts: Column | None = None) -> Column:
    """Bytes that hold a value; ``parts`` are the placed ones of a struct, for whoever has them."""
    zero = F.lit(0).cast("long")
    return F.when(x["tag"] == STRUCT, _bytes_of(x, False, parts)).when(x["tag"] == UNION, _range(zero, _largest(x["m"]))).otherwise(_range(zero, type_size(x)))


def inaccessible_offsets(x: Column, parts: Column | None = None) -> Column:
    return F.when(x["tag"] == STRUCT, _bytes_of(x, True, parts)).when(x["tag"] == UNION, _range(_largest(x["m"]), F.coalesce(x["p"]["s"], F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def start_offsets(x: Column, parts: Column | None = None) -> Column:
    zero = F.lit(0).cast("long")
    return (
        F.when(x["tag"] == ARRAY, F.when((x["s"] > 0) & (_count(x) > 0), F.transform(_range(zero, _count(x)), lambda k: k * x["s"])).otherwise(F.array().cast("array<bigint>")))
        .when(x["tag"] == STRUCT, F.transform(F.filter(placed(x["l"]) if parts is None else parts, lambda p: p["tag"] != PADDING), lambda p: p["at"]))
        .otherwise(F.array(zero))
    )


def tokenize_type(x: Column) -> Column:
    """Tokens of a type, ended by a mark; a union has none: null."""
    end = F.lit(END)
    return (
        F.when(x["tag"] == ARRAY, F.array(F.lit(ARRAY_TOKEN), x["t"], F.concat(F.lit("["), x["n"], F.lit("]")), end))
        .when(x["tag"] == POINTER, F.array(F.lit(POINTER_TOKEN), x["t"], end))
        .when(x["tag"] == STRUCT, F.concat(F.array(F.lit(STRUCT_TOKEN), x["n"]), F.transform(x["l"], _part_string), F.array(end)))
        .when(x["tag"] == UNION, F.lit(None).cast("array<string>"))
        .otherwise(F.array(type_string(x), end))
    )


def detokenize_types(tokens: Column) -> Column:
    """The strings of the types that the tokens spell; a tail without its mark is dropped, short pieces give what they can."""
    cut = F.split(F.concat(F.array_join(tokens, "\x01"), F.lit("\x01")), f"{END}\x01")
    pieces = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda p: F.filter(F.split(p, "\x01"), lambda t: t != ""))

    def text(p: Column) -> Column:
        at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
        n = F.regexp_replace(at(2), r"[\[\]]", "")
        struct = F.when(F.size(p) < 2, "struct").otherwise(F.concat(F.lit("struct "), at(1), F.lit(" { "), F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), "; "), F.lit("; }")))
        array = F.concat(at(1), F.lit("["), F.when(n == "0", "").otherwise(n), F.lit("]"))
        return F.when(at(0) == ARRAY_TOKEN, array).when(at(0) == POINTER_TOKEN, F.concat(at(1), F.lit(" *"))).when(at(0) == STRUCT_TOKEN, struct).otherwise(at(0))

    return F.transform(pieces, text)


def type_key(x: Column) -> Column:
    """A digest by which types are equal: kind, names, type names and padding sizes count, sizes of fields don't."""
    part = lambda p: F.concat_ws("\x02", p["tag"], F.coalesce(p["n"], F.lit("")), F.coalesce(p["t"], F.lit("")), F.when(p["tag"] == PADDING, p["s"].cast("string")).otherwise(F.lit("")))
    parts = lambda a: F.coalesce(F.array_join(F.transform(a, part), "\x03"), F.lit(""))
    size = F.when(x["tag"].isin(SCALAR, ARRAY, PADDING), x["s"].cast("string")).otherwise("")
    return F.sha2(F.concat_ws("\x01", x["tag"], F.coalesce(x["n"], F.lit("")), F.coalesce(x["t"], F.lit("")), size, parts(x["l"]), parts(x["m"]), F.coalesce(x["p"]["s"].cast("string"), F.lit(""))), 256)


def has_padding(x: Column) -> Column:
    return F.coalesce(F.exists(x["l"], lambda p: p["tag"] == PADDING), F.lit(False)) | ((x["tag"] == UNION) & x["p"].isNotNull())
