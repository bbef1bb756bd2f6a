"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, how often the mix takes it. Of all rates from 0 to ``cap`` with sum of r * size = target in
each source, entropy balancing takes those nearest to one copy of every document, by relative entropy. They are
r = min(cap, exp(lambda * size / mean size)) with one multiplier for each source, the maximum of the convex
dual. Newton steps find the multipliers: each step sums gradient and curvature over the table of distinct sizes and moves all
multipliers at once; steps that leave the bracket known so far are replaced by its middle. Sources, multipliers and brackets
stay in tables, so their number has no bound; the driver sees how many sources are still open.

The rates are then rounded to copies: within bounded groups of a source, from the largest document to the smallest, a
rate is rounded up whenever the words owed so far reach half the document, so the words taken stay near their sum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, cut, unused

CAP, PATTERN = 3, (1, 2, 3)
#: Documents in a group that is rounded together, on average.
GROUP = 2000
#: Of a source's target, what its rates may miss; and the steps after which that is an error.
TOLERANCE, STEPS = 1e-7, 200


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources (source, ...) with rank, from 0 in order of code points, null last: ranges are ranked by themselves."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
    dealt = scratch.keep(ordered.withColumn("part", F.spark_partition_id()))
    # One row for each partition.
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("own", own).join(before, "part").withColumn("rank", F.col("before") + F.col("own") - 1).drop("part", "before", "own")


def targets(sources: DataFrame, scratch: Scratch, pattern: tuple[int, ...] = PATTERN, cap: int = CAP) -> DataFrame:
    """sources (source, words; each source once) with rank and target: shares by weight of all words, none above cap times the source's.

    Sources in order of code points, null last, weigh as pattern says, over and over. What a source can't take is
    shared by weight among the others until none is above.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in pattern)), (F.col("rank") % len(pattern) + 1).cast("int"))
    most = (F.col("words") * cap).cast("double")
    state = scratch.keep(_ranked(sources, scratch).withColumn("weight", weight).withColumn("target", F.lit(None).cast("double")))
    all_words = state.agg(F.sum("words")).first()[0] or 0
    while True:
        fixed, total = state.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(F.col("target").isNull(), F.col("weight")))).first()
        if total is None:
            return state.drop("weight")
        share = F.lit(float(all_words) - fixed) * F.col("weight") / F.lit(total)
        over = F.col("target").isNull() & (share > most)
        if state.where(over).isEmpty():
            return state.withColumn("target", F.coalesce("target", share)).drop("weight")
        state = scratch.keep(state.withColumn("target", F.when(over, most).otherwise(F.col("target"))))


def multipliers(histogram: DataFrame, goals: DataFrame, scratch: Scratch, cap: int, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """rank, at: Newton's multipliers for histogram (rank, x, words) and goals (rank, words, target).

    x is a size over the source's mean, words the sum of the sizes that have it. A target of nothing or of everything has an infinite
    multiplier. Sources whose words don't come as near to their target as tolerance says within the steps are an error.
    """
    infinite = F.when(F.col("target") <= 0, F.lit(-math.inf)).when(F.col("target") >= F.col("words") * cap, F.lit(math.inf))
    start = goals.select("rank", "target", F.coalesce(infinite, F.lit(0.0)).alias("at"), ((F.col("words") > 0) & infinite.isNull()).alias("open"))
    state = scratch.keep(start.withColumns({"low": F.lit(-math.inf), "high": F.lit(math.inf)}))
    log_cap = math.log(cap)
    for _ in range(steps):
        asked = state.where("open").select("rank", "at")
        if asked.isEmpty():
            return state.select("rank", "at")
        tilt = F.col("at") * F.col("x")
        rate = F.exp(F.least(tilt, F.lit(log_cap)))
        sums = histogram.join(asked, "rank").groupBy("rank").agg(
            F.sum(F.col("words") * rate).alias("taken"), F.sum(F.when(tilt < log_cap, F.col("words") * F.col("x") * rate).otherwise(0.0)).alias("slope")
        )
        miss = F.col("taken") - F.col("target")
        moves = F.col("open") & (F.abs(miss) > tolerance * F.col("target"))
        next_ = state.join(sums, "rank", "left").withColumn("open", F.coalesce(moves, F.lit(False)))
        next_ = next_.withColumn("low", F.when(F.col("open") & (miss < 0), F.col("at")).otherwise(F.col("low")))
        next_ = next_.withColumn("high", F.when(F.col("open") & (miss >= 0), F.col("at")).otherwise(F.col("high")))
        newton = F.col("at") - F.when(F.col("slope") > 0, miss / F.col("slope"))
        bounded = (F.col("low") > -math.inf) & (F.col("high") < math.inf)
        other = F.when(bounded, (F.col("low") + F.col("high")) / 2).otherwise(F.col("at") * 2 + F.when(miss < 0, 1).otherwise(-1))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(other)
        state = scratch.keep(next_.withColumn("at", F.when(F.col("open"), step).otherwise(F.col("at"))).select(*state.columns))
    raise RuntimeError(f"{state.where('open').count()} sources have not come within {tolerance} of their targets in {steps} steps")


def _row_key(docs: DataFrame) -> list[Column]:
    """Two longs, never null, that rows share only if they are equal in doc_id, source and text."""
    columns = [docs[c] for c in ("doc_id", "source", "text")]
    # Hashes pass over nulls, so which are null is hashed too.
    nulls = [c.isNull() for c in columns]
    return [F.xxhash64(*nulls, *columns), F.xxhash64(*reversed(columns), F.lit(1), *nulls)]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a key, k1 and k2, of each row of docs (doc_id, text, source)."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    k1, k2 = _row_key(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), k1.alias("k1"), k2.alias("k2"))


_DECIDED = "k1 long, k2 long, size long, source_size long, target double, rate double, copies long"


def _rounded(group: pa.Table, cap: int) -> pa.Table:
    """Copies for the rates of a group of rows, none of which is null."""
    group = group.sort_by([("size", "descending"), ("k1", "ascending"), ("k2", "ascending")])
    rate, size, n = (group.column(c).to_numpy() for c in ("rate", "size", "n"))
    whole = np.floor(rate)
    words = (size * n).astype(np.float64)
    owed, up = 0.0, np.zeros(len(words), np.int64)
    for i, part in enumerate(((rate - whole) * words).tolist()):
        owed += part
        if part > 0 and 2 * owed >= words[i]:
            up[i], owed = 1, owed - words[i]
    copies = np.minimum(whole.astype(np.int64) + up, cap)
    return group.drop_columns(["n", "rank", "group"]).append_column("copies", pa.array(copies))


def decisions(rows: DataFrame, scratch: Scratch, pattern: tuple[int, ...] = PATTERN, cap: int = CAP) -> DataFrame:
    """k1, k2, size, source_size, target, rate, copies for each distinct key of rows, which are what sized() returns."""
    classes = scratch.keep(rows.groupBy("k1", "k2").agg(F.min("source").alias("source"), F.min("size").alias("size"), F.count("*").alias("n")))
    per = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.count("*").alias("classes"))
    mean = F.greatest("words", F.lit(1)) / F.greatest("docs", F.lit(1))
    groups = F.greatest(F.ceil(F.col("classes") / GROUP), F.lit(1))
    told = scratch.keep(targets(per, scratch, pattern, cap).select(F.col("source").alias("name"), "rank", "words", "target", mean.alias("mean"), groups.alias("groups")))
    known = classes.join(told, F.col("source").eqNullSafe(F.col("name")))
    histogram = known.where("size > 0").groupBy("rank", (F.col("size") / F.col("mean")).alias("x")).agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("words"))
    at = multipliers(scratch.keep(histogram), told, scratch, cap)
    rate = F.exp(F.least(F.col("at") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))
    # An infinite multiplier is a rate of 0 or of cap for every size; without words a rate is 1.
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("at") == -math.inf, F.lit(0.0)).when(F.col("at") == math.inf, F.lit(float(cap))).otherwise(rate)
    rated = classes.join(told.join(at, "rank"), F.col("source").eqNullSafe(F.col("name"))).withColumn("rate", rate)
    narrow = rated.select("k1", "k2", "size", F.col("words").alias("source_size"), "target", "rate", "n", "rank", F.pmod("k2", "groups").alias("group"))
    return narrow.groupBy("rank", "group").applyInArrow(lambda group: _rounded(group, cap), _DECIDED)


def mixed_rows(docs: DataFrame, pattern: tuple[int, ...] = PATTERN, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs (doc_id, text, source).

    Null texts have size 0, a null source is a source of its own, a null id is an id like any other. Rows equal in id, source and
    text get the same copies. Texts without words have one copy. Other columns are ignored, whatever their names. Each row comes back
    once. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(sized(docs))
        made = decisions(rows, scratch, pattern, cap).drop("size")
        joined = rows.join(made, ["k1", "k2"])
        return cut(joined.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def mixture(docs: DataFrame, pattern: tuple[int, ...] = PATTERN, cap: int = CAP) -> DataFrame:
    """The rows of docs, all their columns whatever their names, each as often as the mix takes it (as mixed_rows() says).

    A row without words, a null or empty text included, stays once. Rows with null ids or sources and repeated rows each count; an
    empty table gives an empty result.
    """
    k1, k2, copies, turn = unused(docs.columns, "k1", "k2", "copies", "turn")
    with Scratch(docs.sparkSession) as scratch:
        made = decisions(scratch.keep(sized(docs)), scratch, pattern, cap).where("copies > 0")
        made = cut(made.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("copies").alias(copies)))
    own = _row_key(docs)
    joined = docs.withColumns({k1: own[0], k2: own[1]}).join(made, [k1, k2])
    again = joined.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))
