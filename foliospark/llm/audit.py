"""Filter interaction audit: what each filter removes at each step of every order in which filters can be applied.

A document's failures are one bit for each filter, so all that an audit needs of the corpus is how many documents, good and toxic ones
among them, have each mask: 32 cells a part for five filters. All orders are then visited by adjacent transpositions: each differs from the
one before it by one swap of neighbours, which leaves all other steps as they were, so only the two affected steps are counted anew from the
cells. What a filter removes is added up along the walk; over all orders this is its Shapley value times their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Filters that an audit takes at most: the result has a row for each step of each order.
MOST_FILTERS = 7
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def transpositions(n: int) -> Iterator[int]:
    """The places i whose swaps with i + 1 lead through all orders of n things, each once."""
    if n < 2:
        return
    inner, falling = transpositions(n - 1), True
    while True:
        # The last thing moves through all places; between its journeys the others make one swap.
        yield from range(n - 2, -1, -1) if falling else range(n - 1)
        swap = next(inner, None)
        if swap is None:
            return
        yield swap + falling
        falling = not falling


def steps_of_all_orders(cells: np.ndarray, names: str) -> pd.DataFrame:
    """filter_order, step and the counts, of cells: documents, good ones and toxic ones of each mask (3 x 2^k); bit i of a mask is filter i."""
    k, masks = len(names), np.arange(cells.shape[1])

    def step(order: list[int], i: int) -> np.ndarray:
        earlier, own = sum(1 << f for f in order[:i]), 1 << order[i]
        passed, fails = (masks & earlier) == 0, (masks & own) != 0
        removed, good, toxic = cells[:, passed & fails].sum(axis=1)
        return np.array([cells[0, passed & ~fails].sum(), removed, cells[0, fails & ~passed].sum(), cells[0, own], good, toxic])

    order = list(range(k))
    steps = np.stack([step(order, i) for i in range(k)])
    shapley, orders, seen = np.zeros(k, np.int64), [], []
    for swap in [None, *transpositions(k)]:
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            steps[swap], steps[swap + 1] = step(order, swap), step(order, swap + 1)
        shapley[order] += steps[:, 1]
        orders.append(list(order))
        seen.append(steps.copy())
    of = np.array(orders).ravel()
    counts = np.concatenate((np.concatenate(seen), shapley[of, None]), axis=1)
    told = pd.DataFrame({"filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))})
    return pd.concat([told, pd.DataFrame(counts.astype(np.int64), columns=_COUNTS)], axis=1)


def audited(cells: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step and the counts for each part of cells (part, mask, n, good, toxic), a letter in names for each filter."""
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"between 1 and {MOST_FILTERS} different letters are filters")
    size = 1 << len(names)
    # At most one row for each mask of a part.
    summed = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, rows in zip(pdf["part"], pdf["cells"]):
                table = np.zeros((3, size), np.int64)
                for cell in rows:
                    table[:, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                told = steps_of_all_orders(table, names)
                told.insert(0, "part", part)
                yield told

    return parts.mapInPandas(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters that look at it alone: few words, few distinct ones, many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def cells_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of documents (doc_id, text, lang) with labels (doc_id, quality, toxic): the four text failures and, as
    bit 4, being identical to the text of a smaller doc_id.

    Equal texts are told by SHA-256 and counted by id and part before they meet, so a text that most rows have moves as a few rows. Their ids are joined
    with labels in rows without texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(text_failures(text))), F.lit(0))
    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
    ).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    flags = lambda df: df.withColumns({"quality": F.coalesce("quality", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    labeled = flags(told.where("doc_id is not null").join(known, "doc_id", "left"))
    labeled = labeled.unionByName(told.where("doc_id is null").withColumns({"quality": F.lit(0), "toxic": F.lit(0)}))
    # Of each text, part, mask and label: all rows, those without an id, and the least id with its rows.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    groups = labeled.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least)
    first = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    met = groups.join(first, "digest")
    firsts = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    halves = F.explode(F.array(F.struct(F.col("mask").alias("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n")))).alias("half")
    rows = met.select("part", "quality", "toxic", halves).select("part", "half.mask", "half.n", (F.col("half.n") * F.col("quality")).alias("good"), (F.col("half.n") * F.col("toxic")).alias("toxic"))
    return rows.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audited_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of five filters, A to E, in all 120 orders.

    part is lang; null and empty ones are one part. Null texts are empty ones: they fail A, and E if a smaller doc_id has an empty or null text.
    Rows that repeat a doc_id are documents of their own that don't fail E by each other; a null doc_id is smaller
    than none and has no labels. A document is good or toxic if any row of labels says so. Other columns are ignored. An empty
    table of documents gives an empty result; documents without labels are neither good nor toxic.
    """
    return cut(audited(cells_of(docs, labels), "ABCDE"))
