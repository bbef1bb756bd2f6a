"""URL filters by a sort-merge range join over reversed-host keys, in DataFrame functions only.

A host's key is its labels in reverse, each ended by a dot: ``www.example.com`` -> ``com.example.www.``. The keys of a
rule's host and of all its subdomains are those that start with the rule's key, which is an interval in byte order:
from ``com.example.`` to before ``com.example/`` (the next byte after the dot). Such intervals nest or are apart. Rules
thus make a sorted list of events, each with the stack of rule hosts that are active from there on: a start has its
host above the enclosing ones, an end has the stack of the host around it. A sweep over hosts and events in key order
gives each host the latest stack.

The paths of a rule host's rules are intervals as well: what starts with ``/en/`` lies from ``/en/`` to before ``/en/`` and a byte
beyond all text. A second sweep, over the paths that are asked of a rule host and the events of its rules, gives the longest
rule that is active: a start has its own rule, an end the rule that is left on top of the stack, of which each event knows the level. Of the rules so found for a url's
enclosing hosts, the longest decides.

Sweeps run over distinct hosts and distinct paths of a host, so that a host or url with most of the rows counts once. They are dealt by
ranges of the key; each range begins with what the ranges before it left active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut

DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to the next ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def swept(points: DataFrame, events: DataFrame, order: list[str], value: str, scratch: Scratch) -> DataFrame:
    """points (order columns) with the value of the last event (order columns, value, never null) at or before each, null before all.

    Both are dealt by ranges of the order and swept range by range. One row for each range tells what was active before it.
    """
    both = points.withColumn("turn", F.lit(1)).unionByName(events.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    dealt = scratch.keep(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.max_by(value, F.when(F.col("turn") == 0, F.struct(*order))).alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    own = Window.partitionBy("part").orderBy(*order, "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = dealt.withColumn("own", F.last(value, ignorenulls=True).over(own)).where("turn = 1")
    return latest.join(carried, "part").select(*points.columns, F.coalesce("own", "carried").alias(value))


def host_events(hosts: DataFrame) -> DataFrame:
    """key, stack for rule hosts (host): where the set of active hosts changes, and to what (an array, the outermost first)."""
    own = hosts.withColumn("key", host_key(F.col("host")))
    # Every key that encloses a host's, itself included, by number of labels.
    depth = F.size(F.split("key", r"\.")) - 1
    around = own.select("key", F.explode(F.sequence(F.lit(1), depth)).alias("depth"))
    around = around.withColumn("outer", F.concat(F.expr("substring_index(key, '.', depth)"), F.lit(".")))
    stacks = around.join(own.select(F.col("key").alias("outer"), "host"), "outer").groupBy("key")
    stacks = stacks.agg(F.sort_array(F.collect_list(F.struct("depth", "host"))).alias("all"))
    stacks = stacks.select("key", F.col("all.host").alias("stack"))
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    return stacks.union(stacks.select(end, F.expr("slice(stack, 1, size(stack) - 1)")))


def path_events(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """rule_host, at (binary), active for rules (host, path, verdict, each host and path once): where the longest active rule changes, and to what.

    The stack of a host's nested rules is kept by its levels: a start raises the level by one, an end lowers it, and the rule that is active
    on a level is the last one that started there. Levels are running sums over the sorted events; what an end leaves active is the last start
    of its level, found by a sweep in order of levels. So the work doesn't depend on how deep rules are nested. active.rule has a rule's
    length, its host's length and its verdict; its text is what the url begins with.
    """
    rule = F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), "verdict")
    start = F.col("path").cast("binary")
    # No text has the byte 255, so starts and ends never meet, and what starts within a rule ends before it.
    bounds = F.array(
        F.struct(start.alias("at"), F.lit(1).alias("step"), rule.alias("own")),
        F.struct(F.concat(start, F.lit(b"\xff")).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("struct<length:int,host_length:int,verdict:string>").alias("own")),
    )
    events = rules.select(F.col("host").alias("rule_host"), F.explode(bounds).alias("e")).select("rule_host", "e.*")
    dealt = scratch.keep(events.repartitionByRange("rule_host", "at").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("part").agg(F.sum("step").alias("rise")).select("part", F.coalesce(F.sum("rise").over(before), F.lit(0)).alias("carried"))
    own = Window.partitionBy("part").orderBy("rule_host", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leveled = scratch.keep(dealt.withColumn("rise", F.sum("step").over(own)).join(carried, "part").select("rule_host", "at", "own", (F.col("rise") + F.col("carried")).alias("level")))
    level = ["level", "rule_host", "at"]
    starts, ends = leveled.where("own is not null"), leveled.where("own is null")
    left = swept(ends.where("level > 0").select(*level), starts.select(*level, "own"), level, "own", scratch).select("rule_host", "at", "own")
    found = starts.select("rule_host", "at", "own").union(left).union(ends.where("level = 0").select("rule_host", "at", "own"))
    return found.select("rule_host", "at", F.struct(F.col("own").alias("rule")).alias("active"))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url), by rules (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's path (case matters). The
    longest rule (host and path together) wins; of equally long ones that with the longer host; of rules with equal host and path the
    verdict that is last by code points. Rules without a host or with a null path fit nothing. Urls that no rule fits, null urls and those
    without ``://`` get a null rule and the default verdict. Null ids, repeated rows and other columns make no difference.
    Empty tables give an empty result, or the default for all.
    """
    with Scratch(pages.sparkSession) as scratch:
        urls = scratch.keep(pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
        known = rules.where("host <> '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        pairs = scratch.keep(urls.select("host", "path").distinct())
        hosts = pairs.select("host").distinct().withColumn("key", host_key(F.col("host")))
        stacks = swept(hosts, host_events(known.select("host").distinct()), ["key"], "stack", scratch)
        around = scratch.keep(stacks.select("host", F.explode("stack").alias("rule_host")))
        asked = pairs.join(around, "host").withColumn("at", F.col("path").cast("binary"))
        found = swept(asked.select("rule_host", "at").distinct(), path_events(known, scratch), ["rule_host", "at"], "active", scratch)
        best = asked.join(found.where("active.rule is not null"), ["rule_host", "at"]).groupBy("host", "path").agg(F.max("active.rule").alias("best"))
        judged_ = urls.join(best, ["host", "path"], "left")
        rule = F.concat(F.expr("right(host, best.host_length)"), F.expr("left(path, best.length - best.host_length)"))
        return cut(judged_.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
