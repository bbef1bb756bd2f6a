"""SimHash fingerprints, in DataFrame functions only.

Each word's 64-bit hash votes on 64 bits with the word's weight (times its occurrences); the fingerprint has the bits that
more than half of all weight voted for. Votes are sums: two bits share a long, 32 bits apart, so 32 sums make a
fingerprint. Likeness is the share of equal bits. Permuted block tables find all pairs within a Hamming radius.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows in an id range, on average, up to MAX_RANGES ranges; beyond that ranges grow. Bounds are looked up in two steps, STEP at a time.
RANGE, MAX_RANGES, STEP = 4000, 16_384, 128
#: Bits in which near fingerprints differ at most.
RADIUS = 3
_LANES = (1 << 32) | 1


def in_ranges(df: DataFrame, rows: int = RANGE) -> DataFrame:
    """df (with doc_id) and its id range: ranges of about equally many rows, in ascending order of doc_id, null first."""
    n = min(MAX_RANGES, max(1, -(-df.count() // rows)))
    if n == 1:
        return df.withColumn("range", F.lit(0))
    shares = [i / n for i in range(1, n)]
    bounds = df.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return df.withColumn("range", F.lit(0))
    before = lambda part: F.coalesce(F.size(F.filter(part, lambda b: b <= F.col("doc_id"))), F.lit(0))
    steps = F.greatest(before(F.lit(bounds[::STEP])) - 1, F.lit(0)) * STEP
    return df.withColumn("range", steps + before(F.slice(F.lit(bounds), steps + 1, STEP)))


def with_next(df: DataFrame, columns: dict[str, str], order: list[str]) -> DataFrame:
    """df (with range) with the values of columns in the next row by order as named, after the last the first row's; and place.

    Ranges are swept by themselves; one row of each range is what they learn from each other.
    """
    w = Window.partitionBy("range").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    values = F.struct(*(F.col(c).alias(new) for c, new in columns.items()))
    # One row for each range, MAX_RANGES at most: found by its number alone, so that wide rows aren't sorted for it.
    number = F.coalesce(F.col(order[0]).cast("long"), F.lit(-(1 << 63)))
    lows = F.broadcast(df.groupBy(F.col("range").alias("low_range")).agg(F.min(number).alias("low")))
    firsts = df.join(lows, (F.col("range") == F.col("low_range")) & (number == F.col("low")))
    firsts = firsts.groupBy("range").agg(F.min_by(values, F.struct(*order)).alias("first"))
    # Which range comes next is settled among the numbers; the rows themselves, which can be long, go from range to range by a join.
    every = Window.orderBy("range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order_ = firsts.select("range", F.coalesce(F.lead("range").over(every), F.first("range").over(whole)).alias("source"))
    handed = order_.join(firsts.withColumnRenamed("range", "source").hint("merge"), "source").select("range", F.col("first").alias("after"))
    swept = df.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead(values).over(w))
    joined = swept.join(handed.hint("merge"), "range").withColumn("next", F.coalesce("next", "after"))
    return joined.select(*df.columns, "place", *(F.col(f"next.{new}").alias(new) for new in columns.values()))


def word_weight(word: Column) -> Column:
    """1 for words of up to three characters, which are mostly function words, one more for each further, up to 7."""
    return F.least(F.greatest(F.length(word) - 2, F.lit(1)), F.lit(7)).cast("long")


def votes(hash_: Column, weight: Column) -> list[Column]:
    return [F.sum(F.shiftright(hash_, k).bitwiseAND(F.lit(_LANES)) * weight).alias(f"v{k}") for k in range(32)] + [F.sum(weight).alias("weight")]


def voted() -> Column:
    """The fingerprint, from the sums that votes() names."""
    bits = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"v{k}"), 32)
        top = 1 << (k + 32)
        for ones, value in ((low, 1 << k), (high, top if top < 1 << 63 else -(1 << 63))):
            bits = bits.bitwiseOR(F.when(ones * 2 > F.col("weight"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key columns and fingerprint (long) of each text; rows equal in the key count as one text. No words: 0.

    Rows already partitioned by a part of the key aren't shuffled.
    """
    words = texts.select(*key, F.explode(F.split(F.col(text), r"[\x20\x09-\x0D]+")).alias("word"))
    # An empty word (there is one in a text without words, or at an end) has no weight but keeps its text.
    words = words.select(*key, F.xxhash64("word").alias("hash"), F.when(F.col("word") == "", F.lit(0).cast("long")).otherwise(word_weight(F.col("word"))).alias("w"))
    return words.groupBy(*key).agg(*votes(F.col("hash"), F.col("w"))).select(*key, voted().alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    return 1.0 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def as_hex(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fingerprint)), 16, "0"))


def edited_likeness(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_fingerprints for
    each row of docs.

    The edited text is the text with its last half (rounded down) replaced by as many first code points of the next
    document, or all it has; next by ascending doc_id (null first; repeated ids by text), after the last the first. Null texts are
    empty; a text without words has fingerprint 0. Repeated rows each appear. near_fingerprints: for a doc_id divisible by
    ``every``, how many other distinct fingerprints of all rows are within the radius of its own; for others null. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(in_ranges(rows), {"text": "next_text"}, ["doc_id", "text"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).select("range", "place", "doc_id", n.alias("n_chars"), "text", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))
    key = ["range", "place", "doc_id", "n_chars", "sha"]
    sides = rows.select(*key, F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))))).alias("x"))
    prints = fingerprints(sides.select(*key, "x.side", "x.text"), [*key, "side"])
    own = F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint")
    other = F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint")
    prints = cut(prints.groupBy(*key).agg(own, other)).withColumnRenamed("place", "at")
    asked = F.col("doc_id") % every == 0
    near = neighbours(prints, prints.where(asked), radius).groupBy(F.col("fingerprint").alias("of")).agg(F.count("*").alias("others"))
    out = with_next(prints, {"fingerprint": "next_fingerprint"}, ["at"]).join(near, asked & (F.col("fingerprint") == F.col("of")), "left")
    return out.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_hex("fingerprint").alias("fingerprint"),
        as_hex("edited_fingerprint").alias("edited_fingerprint"), likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"), F.when(asked, F.coalesce("others", F.lit(0).cast("long"))).alias("near_fingerprints"),
    )


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """fingerprint, near, distance: all pairs of a query's and another distinct fingerprint within the radius.

    prints, queries: fingerprint (long; null ones are left out). The 64 bits fall into ``blocks`` blocks; of two
    fingerprints within the radius at least blocks - radius blocks are equal, so for each choice of that many there
    is a table keyed by these blocks (the permuted tables), and pairs with equal keys are compared in full.
    Equal fingerprints are one: join the result back for their documents. Each pair appears once.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct()
        keyed = F.array(*(F.struct(F.lit(i).alias("table"), F.col(name).bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(chosen)))
        return rows.select(name, F.explode(keyed).alias("t")).select(name, "t.table", "t.key")

    apart = F.col("fingerprint").bitwiseXOR(F.col("near"))
    # A pair can have equal keys in several tables; the first of them has it.
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(chosen)))
    a, b = tables(queries, "fingerprint").alias("a"), tables(prints, "near").alias("b")
    same = (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.col("fingerprint") != F.col("near"))
    # The fingerprints grow with the documents, so neither side is broadcast.
    met = a.join(b.hint("merge"), same & (F.bit_count(apart) <= radius) & (F.col("a.table") == first))
    return met.select("fingerprint", "near", F.bit_count(apart).alias("distance"))
