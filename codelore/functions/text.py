"""Columns over the text and tokens of code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the lexical rules: what is taken as one token, in the order of trial.
COMMENT = r"//[^\n]*|/\*.*?\*/"
STRING = r'"(?:\\.|[^"\\])*"'
CHARACTER = r"'(?:\\.|[^'\\])*'"
PLACEHOLDER = r"@@\w+@@\w+@@\w+"
NUMBER = r"0[xX][0-9a-fA-F]+[uUlL]*|\d+\.\d*(?:[eE][+-]?\d+)?[fFlL]?|\.\d+(?:[eE][+-]?\d+)?[fFlL]?|\d+[eE][+-]?\d+[fFlL]?|\d+[uUlL]*"
NAME = r"[A-Za-z_$]\w*"
OPERATORS = r"->\*|<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|##"
TOKENS = "|".join([COMMENT, STRING, CHARACTER, PLACEHOLDER, NUMBER, NAME, OPERATORS, r"\S"])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body looks at it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def single(tokens: Column, name: str) -> Column:
    """Runs of a token as one."""
    return bound(tokens, lambda known: F.filter(known, lambda t, i: ~((t == name) & (i > 0) & (F.get(known, i - 1) == name))))


def canonicalize_code(code: Column, strict_lines: bool = False) -> Column:
    """Comments to newlines, blanks before a written-out newline and at the end off, placeholders to old names.

    With ``strict_lines`` the blanks at the end of every line go too.
    """
    out = F.regexp_replace(code, r"(?s)//.*?\n|/\*.*?\*/", "\n")
    out = F.regexp_replace(out, r"\s+(?=\\n)|\s+\z", "")
    if strict_lines:
        out = F.regexp_replace(out, r"[ \t]+(?=\n)", "")
    return F.regexp_replace(out, r"@@\w+@@(\w+)@@\w+", "$1")


def tokenize_code(code: Column, literals: bool = True) -> Column:
    """Tokens of C; comments and ``::`` dropped, neighbouring strings merged, literals named."""
    raw = F.regexp_extract_all(code, F.lit(f"(?s)({TOKENS})"), 1)
    kept = F.filter(raw, lambda t: ~(t.startswith("//") | t.startswith("/*") | (t == "::")))
    if not literals:
        return kept
    named = F.transform(kept, lambda t: F.when(t.rlike(r"^[\"']."), "String").when(t.rlike(r"^\.?\d"), "Number").otherwise(t))
    return single(named, "String")


def tokenize_code_old_names(code: Column) -> Column:
    return F.transform(tokenize_code(code), lambda t: F.regexp_replace(t, r"^@@\w+@@(\w+)@@\w+$", "@@$1@@"))


def name_view(tokens: Column, view: str = "RAW") -> Column:
    """A placeholder whole, as its old name, or as its new one."""
    if view == "RAW":
        return tokens
    part = 2 if view == "SOURCE" else 3
    return F.transform(tokens, lambda t: F.when(t.startswith("@@"), F.element_at(F.split(t, "@@"), part + 1)).otherwise(t))


def mark_variables(tokens: Column, names: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(F.array_contains(names, t), F.concat(F.lit("@@"), t, F.lit("@@"))).otherwise(t))


def abstract_lines(code: Column) -> Column:
    """Array of token arrays, one a finished line; literals by kind, runs of strings as one.

    A comment ends a line that has tokens and stays as a token on one that has none.
    """
    lines = F.slice(F.split(code, "\n"), 1, F.greatest(F.size(F.split(code, "\n")) - 1, F.lit(0)))

    def tokens(line: Column) -> Column:
        raw = F.regexp_extract_all(line, F.lit(f"({TOKENS})"), 1)
        named = F.transform(F.filter(raw, lambda t: t != "::"), lambda t: F.when(t.rlike(r"^[\"']."), "<LITERAL_STRING>").when(t.rlike(r"^\.?\d"), "<LITERAL_NUMBER>").otherwise(t))
        return F.filter(single(named, "<LITERAL_STRING>"), lambda t, i: (i == 0) | ~(t.startswith("//") | t.startswith("/*")))

    return F.filter(F.transform(lines, tokens), lambda x: F.size(x) > 0)


def hash_context(tokens: Column) -> Column:
    """Each placeholder as its digest in context: the tokens before it, chained with itself, chained with those from
    it on, other placeholders masked.  Digests are chained in hexadecimal."""

    def one(t: Column, i: Column, masked: Column) -> Column:
        left = F.sha2(F.array_join(F.slice(masked, F.lit(1), i), " "), 256)
        own = F.sha2(F.concat(left, t), 256)
        right = F.sha2(F.concat(own, F.array_join(F.slice(masked, i + 1, F.size(masked) - i), " ")), 256)
        return F.when(t.startswith("@@"), right).otherwise(t)

    masked = F.transform(tokens, lambda t: F.when(t.startswith("@@"), "@@").otherwise(t))
    return bound(masked, lambda known: F.transform(tokens, lambda t, i: one(t, i, known)))


def rename_by_table(tokens: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``@@VAR_n`` of tokens(func, pos, token) as the name that a table (var, ...) has in a column; others stay."""
    numbered = tokens.withColumn("var", F.regexp_extract("token", r"^@@VAR_(\d+)$", 1).try_cast("long"))
    return numbered.join(names.select("var", F.col(column).alias("_name")), "var", "left").select("func", "pos", F.coalesce("_name", "token").alias("token"))


def normalize_pseudocode(code: Column) -> Column:
    lines = F.transform(F.split(code, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.array_join(lines, "\n")


def is_placeholder(token: Column) -> Column:
    return token.startswith("@@") & token.endswith("@@") & (F.char_length(token) > 4)


def placeholder_name(token: Column) -> Column:
    return F.substring(token, F.lit(3), F.char_length(token) - 4)


def preserved_tokens(tokens: DataFrame) -> DataFrame:
    """Distinct marked tokens of a column of token arrays."""
    return tokens.select(F.explode("tokens").alias("token")).where(is_placeholder(F.col("token"))).distinct()


def argument_ids(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring_index(code, "\n", 1), F.lit(r"VAR_(\d+)"), 1))


def type_tokens(kind: Column) -> Column:
    """Tokens of a type; leading underscores off, parentheses out."""
    return F.filter(F.transform(tokenize_code(kind, literals=False), lambda t: F.regexp_replace(t, "^_+", "")), lambda t: ~t.isin("(", ")", ""))
