"""Mixing sources to target weights by entropy balancing, with DataFrame operations alone.

Among all rates between 0 and 3 under which the words of each source come to its target, entropy balancing
takes those nearest to one copy of every document: min(3, exp(multiplier * size)), one multiplier a source.
Newton steps on the convex dual find the multipliers; each step sums over the table of (source, size, documents), which
holds all that the rates depend on, and falls back to halving a bracket.  Rates become whole copies by a hash of
the document; a shift of that hash, found a source by two histograms, brings the words to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Most copies of a document, and how many times its size a source's target may be.
MOST = 3
#: Rounds of Newton steps at most, far more than halving takes, and the relative error that ends them; rounding to
#: copies takes care of the rest.
ROUNDS, CLOSE = 80, 1e-3
SALTS, BINS, FILLS = 32, 2048, 3


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Add its target to every source of sizes(source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; what exceeds 3 times a
    source's size goes to the others by weight.  Filling the sources in the order of size by weight finds who is full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("room", (MOST * F.col("source_size")).cast("double"))
    filling = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / open_).withColumn("full", F.col("weight") * F.col("level") >= F.col("room"))
    free = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # past the first that is not full it falls
    return level.select(*sizes.columns, F.when(F.col("full"), F.col("room")).otherwise(F.col("weight") * free).alias("target"))


def multipliers(histogram: DataFrame, goal: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Add ``unit`` and ``multiplier`` to goal(source, source_size, target, least, docs), from histogram(source, size, n).

    The sizes enter in units of their source's mean, so that multipliers are of the order of one.
    A source without words, and one whose target is all it can give, needs no multiplier: null.  It is an error
    if the words of a source are not near its target after so many rounds.
    """
    unit, ratio = F.col("source_size") / F.col("docs"), F.col("target") / F.col("source_size")
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-12))
    state = goal.withColumn("unit", F.when(F.col("docs") > 0, unit)).withColumns({
        "low": F.when(solvable, F.least(F.lit(0.0), F.log(ratio)) * F.col("unit") / F.col("least")),
        "high": F.when(solvable, F.lit(math.log(MOST)) * F.col("unit") / F.col("least")),
        "multiplier": F.when(solvable, F.lit(0.0)),
        "off": F.when(solvable, F.lit(1.0)),
    })
    state = cut(state)
    for _ in range(rounds):
        state = cut(_step(histogram, state))
        if state.where(F.col("off") > CLOSE).isEmpty():
            break
    else:
        raise RuntimeError(f"no multipliers after {rounds} rounds for {state.where(F.col('off') > CLOSE).count()} sources")
    return state.select("source", "source_size", "target", "unit", "multiplier")


def _step(histogram: DataFrame, state: DataFrame) -> DataFrame:
    """A Newton step of every source that isn't close yet: its words and their slope at its multiplier, and the next one."""
    most = math.log(MOST)
    power = F.col("multiplier") * F.col("size") / F.col("unit")
    words, rate = F.col("n") * F.col("size"), F.exp(F.least(power, F.lit(most)))
    kept = [c for c in state.columns if c != "source"]
    joined = histogram.join(state.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    slope = F.when(power < most, words * F.col("size") / F.col("unit") * rate).otherwise(0.0)
    sums = joined.groupBy("source").agg(*(F.max(c).alias(c) for c in kept), F.sum(words * rate).alias("_words"), F.sum(slope).alias("_slope"))
    gap, at = F.col("_words") - F.col("target"), F.col("multiplier")
    low = F.when(gap < 0, at).otherwise(F.col("low"))
    high = F.when(gap > 0, at).otherwise(F.col("high"))
    newton = at - gap / F.col("_slope")
    inside = (F.col("_slope") > 0) & (newton > low) & (newton < high)
    off = F.abs(gap) / F.col("target")
    next_ = F.when(off <= CLOSE, at).otherwise(F.round(F.when(inside, newton).otherwise((low + high) / 2), 12))
    open_ = F.col("off") > CLOSE
    new = {"low": low, "high": high, "multiplier": next_, "off": off}
    return sums.select("source", *(F.when(open_, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in kept))


def _by_source(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Join rows to their source's line; a source is dealt over many tasks, since one may hold a third of all rows."""
    many = goal.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = [F.col("source").eqNullSafe(F.col("_source")), F.col("_s") == F.col("_salt")]
    return rows.withColumn("_s", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).join(many, key).drop("_source", "_salt", "_s")


def _crossing(rows: DataFrame, goal: DataFrame, width: float, into: str) -> DataFrame:
    """Add to goal the end of the last bin of ``jump`` up to which the running sizes are no more than ``aim``.

    Takes rows(source, size, jump, aim), with jumps from 0; what lies before 0 counts as bin -1.
    """
    bins = rows.withColumn("_bin", F.greatest(F.lit(-1), F.floor(F.col("jump") / width))).where(F.col("_bin") < BINS).groupBy("source", "_bin").agg(F.sum("size").alias("_size"), F.max("aim").alias("aim"))
    running = F.sum("_size").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    fit = bins.withColumn("_to", running).groupBy("source").agg(F.coalesce(F.max(F.when(F.col("_to") <= F.col("aim"), F.col("_bin"))), F.lit(-1)).alias("_fit"))
    fit = fit.select(F.col("source").alias("_r"), ((F.col("_fit") + 1) * width).alias(into))
    return cut(goal.join(fit, goal["source"].eqNullSafe(F.col("_r")), "left").drop("_r"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row of docs(doc_id, text, source).

    A null text has size 0 and is taken 0 words; a null source is a source, the last one.  Rows of one
    doc_id and size get the same copies.  An empty table gives an empty one.
    """
    rows = cut(docs.select("doc_id", "source", word_count(text).alias("size")))
    histogram = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    words = F.col("size") > 0
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.min(F.when(words, F.col("size"))).alias("least"), F.sum(F.when(words, F.col("n"))).alias("docs"))
    return _rounded(rows, multipliers(histogram, targets(sizes)))


def _rounded(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Whole copies by the rates and a number of each document in [0, 1), shifted until the words come to the target."""
    power = F.col("multiplier") * F.col("size") / F.col("unit")
    all_of_it = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    rate = F.when(F.col("multiplier").isNotNull(), F.exp(F.least(power, F.lit(math.log(MOST))))).otherwise(F.when(all_of_it, F.lit(float(MOST))).otherwise(F.lit(0.0)))
    level = rate + F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("copies")), 24) / float(1 << 40)
    solved = F.col("multiplier").isNotNull() & (F.col("size") > 0)
    # Shifted by s, a document has floor(level + s) copies: one more from s = k - level on, k = 1 to 3.
    jump = F.explode(F.array(*[F.lit(k) - level for k in range(1, MOST + 1)]))
    span = float(MOST + 1)
    jumps = _by_source(rows, goal).where(solved).select("source", "size", "target", jump.alias("jump"))
    goal = _crossing(jumps.select("source", "size", F.col("target").alias("aim"), (F.col("jump") + span).alias("jump")), goal, 2 * span / BINS, "_coarse")
    jumps = _by_source(rows, goal).where(solved).select("source", "size", "target", "_coarse", jump.alias("jump"))
    goal = _crossing(jumps.select("source", "size", F.col("target").alias("aim"), (F.col("jump") + span - F.col("_coarse")).alias("jump")), goal, 2 * span / BINS / BINS, "_fine")
    shift = F.coalesce(F.col("_coarse") + F.col("_fine") - span, F.lit(0.0))
    whole = F.when(F.col("multiplier").isNull(), rate).otherwise(F.floor(level + shift)).cast("long")
    copies = F.greatest(F.lit(0), F.least(F.lit(MOST), whole)).cast("long")
    # A long document may stand before the target: others that still fit get one more copy, a few times over.
    for k in range(FILLS):
        taken = _by_source(rows, goal).groupBy("source").agg((F.max("target") - F.sum(copies * F.col("size"))).alias(f"_room{k}")).withColumnRenamed("source", "_r")
        goal = cut(goal.join(taken, goal["source"].eqNullSafe(F.col("_r")), "left").drop("_r"))
        lot = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(f"fill {k}")), 24) / float(1 << 40)
        fits = (F.col("size") > 0) & (F.col("size") <= F.col(f"_room{k}")) & (copies < MOST)
        lots = _by_source(rows, goal).where(fits).select("source", "size", F.col(f"_room{k}").alias("aim"), lot.alias("jump"))
        goal = _crossing(lots, goal, 1 / BINS, f"_until{k}")
        copies = copies + F.when(fits & (lot < F.col(f"_until{k}")), 1).otherwise(0)
    last = _by_source(rows, goal)
    return last.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
