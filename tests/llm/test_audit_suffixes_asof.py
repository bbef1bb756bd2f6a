"""Filter audit, removal by previous factors and as-of join against brute force and SQL, with odd rows and small limits."""

import hashlib
import itertools
import math
import random
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import asof, audit, suffixes

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Filter audit.


@pytest.mark.parametrize("n", range(1, 6))
def test_transpositions_visit_each_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in audit.transpositions(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == math.factorial(n) and set(seen) == set(itertools.permutations(range(n)))


def brute_audit(docs, labels):
    """Every order applied one filter after another to the documents themselves."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}

    def fails(i, text):
        words, text = WORD.findall(text or ""), text or ""
        same = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": bool(set(text) & set("#$%&*|")), "E": same,
        }

    known = [(lang or "", i, fails(i, text)) for i, text, lang in docs]
    out = []
    for part in {p for p, _, _ in known}:
        rows, totals = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = [(i, f) for p, i, f in known if p == part], []
            for step, letter in enumerate(order, 1):
                now, left = [x for x in left if x[1][letter]], [x for x in left if not x[1][letter]]
                unique = sum(p == part and [k for k in f if f[k]] == [letter] for p, _, f in known)
                row = [len(left), len(now), sum(f[letter] for _, f in gone), unique, sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                rows.append((part, "".join(order), step, *row))
                totals[letter] += len(now)
                gone += now
        out += [(*r, totals[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


AUDIT_DOCS = [
    (1, "Some text " * 150, "en"), (2, "Some text " * 150, "de"), (3, " ".join(f"w{i}" for i in range(250)), "en"), (4, " ".join(f"W{i}" for i in range(250)), "en"),
    (5, None, None), (6, "", ""), (6, "", ""), (7, "# few words", "en"), (8, "# few words", "en"), (None, "# few words", "en"), (None, "", None),
    (9, " ".join(f"w{i}%" for i in range(250)), "en"), (10, "A\x85B \x1f\xa0 é𝄞", "fr"), (11, " ".join(f"w{i}" for i in range(250)), "en"), (3, "x", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (7, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]


def test_audit_equals_every_order_applied(spark):
    docs = spark.createDataFrame(AUDIT_DOCS, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "mask": F.lit(1), "n": F.lit("y"), "quality": F.lit(0)})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("x"))
    assert sorted(map(tuple, audit.audited_documents(docs, labels).collect())) == brute_audit(AUDIT_DOCS, LABELS)
    assert audit.audited_documents(docs.where("false"), labels).count() == 0
    assert {r.good_lost for r in audit.audited_documents(docs, labels.where("false")).collect()} == {0}


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 0, 0), ("p", 3, 1, 1, 0), ("p", 1, 1, 0, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audited(cells, "xy").collect()}
    assert got == {("xy", 1): (5, 4, 0, 3, 1, 1, 7), ("xy", 2): (5, 0, 1, 0, 0, 0, 1), ("yx", 1): (8, 1, 0, 0, 1, 0, 1), ("yx", 2): (5, 3, 1, 3, 0, 1, 7)}
    with pytest.raises(ValueError):
        audit.audited(cells, "xx")


# Removal by previous factors.


def brute_kept(rows, length):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - length + 1 if i is not None else 0):
            key = data[s : s + length]
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1 if i is not None else 0):
            if first[data[s : s + length]] < (i, s):
                gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0)).reshape(-1, 2)
        out.append((i, bytes(np.frombuffer(data, np.uint8)[~gone[:-1]]), [tuple(map(int, e)) for e in edges]))
    return out


def found(df):
    return sorted(((r.doc_id, bytes(r.kept), [(s.begin, s.end) for s in r.spans]) for r in df.collect()), key=repr)


def planted(seed, n=60):
    """Texts of random words and of pieces that many share, cut anywhere, with repeats inside a text, copies and edits."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "é", "☃", "𝄞", "de", "\n"]
    source = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            text = rng.choice(source)
            a, b = sorted((rng.randrange(len(text)), rng.randrange(len(text))))
            parts += [text[a:b], " ".join(str(rng.random()) for _ in range(rng.randrange(6)))]
        rows.append((rng.randrange(n), "".join(parts)))
        if rng.random() < 0.2:
            rows.append((rng.randrange(n), rows[-1][1]))
    return rows


ODD = [
    (3, "a" * 400), (1, "a" * 150), (2, None), (4, ""), (5, "short"), (None, "a" * 300), (None, None), (6, "ab" * 200), (6, "ab" * 200), (6, "ab" * 90 + "c" * 120), (7, "c" * 100), (8, "x" * 99 + "y"), (9, "x" * 99 + "y"), (9, "x" * 99 + "y" + "z"),
]


@pytest.mark.parametrize("length, sizes", [(100, {}), (100, {"gathered": 50, "crowded": 2, "most_open": 3, "open_bytes": 2000}), (30, {"gathered": 200, "crowded": 5}), (7, {"most_open": 2, "open_bytes": 500}), (1, {})])
def test_kept_bytes_equal_brute_force(spark, length, sizes):
    rows = planted(length) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit("m"), "spans": F.lit(1), "kept": F.lit(0)}).repartition(5)
    assert found(suffixes.without_repeats(docs, length, **sizes)) == sorted(brute_kept(rows, length), key=repr)


def test_texts_longer_than_a_pass(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PASS", 700)
    rng = random.Random(5)
    long_ = "".join(rng.choice("abcd ") for _ in range(5000))
    rows = [(1, long_), (2, long_[100:3000] + "!" + long_[3000:4500]), (3, long_[:699] + long_)]
    runs = [part for i, t in rows for part in suffixes._runs_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 100)]
    assert sum((p[-1] + 1).sum() for p in runs) == sum(len(t) - 99 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffixes.without_repeats(docs)) == sorted(brute_kept(rows, 100), key=repr)


def test_kept_bytes_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    from foliospark.llm import queries

    got = sorted(map(tuple, queries.op12_suffix_dedup(spark, DATA).collect()))
    want = [(i, len((t or "").encode()), len((t or "").encode()) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for (i, t), (_, kept, spans) in zip(rows, brute_kept(rows, 100))]
    assert got == sorted(want) and sum(w[2] for w in want) > 0
    assert suffixes.without_repeats(docs.where("false")).count() == 0


# As-of join.


def brute_matches(clicks, sales):
    crc = lambda i: zlib.crc32(str(i).encode())
    us = lambda t: None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    used = lambda i, t: t if t is None or i is None or crc(i) % 2 == 0 else t - t % asof.FLOOR_US
    orders = []
    for i, client, total, at in sales:
        cents = None if total is None or not math.isfinite(total) else math.floor(100 * total + 0.5)
        orders.append((client, used(i, us(at)), cents, i))
        if i is not None and crc(i) % 3:
            orders.append((client, used(i, us(at)), cents, -1 - i))
    out = []
    for i, client, ts in {c for c in clicks if c[0] is not None} | set() or set():
        out.append((i, client, used(i, us(ts))))
    out += [(None, client, us(ts)) for i, client, ts in clicks if i is None]
    rows = []
    for i, client, ts in out:
        own = [o for o in orders if client is not None and ts is not None and o[0] == client and o[1] is not None and 0 <= ts - o[1] <= asof.TOLERANCE_US]
        if not own:
            rows.append((i, client, ts, None, None, None, 0))
            continue
        low = -(1 << 62)
        best = max(own, key=lambda o: (o[1], low if o[2] is None else o[2], low if o[3] is None else o[3]))
        rows.append((i, client, ts, best[3], ts - best[1], best[2], sum(o[1] == best[1] for o in own)))
    return sorted(rows, key=repr)


def shop(seed, n):
    rng = random.Random(seed)
    time = lambda: None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rng.choice([rng.randrange(3000), rng.randrange(30)]), microseconds=rng.choice([0, rng.randrange(10**9)]))
    client = lambda: rng.choice([None, 1, 1, 1, 2, 3, rng.randrange(50)])
    total = lambda: rng.choice([None, 1.005, 2.5, 2.5, float("nan"), float("inf"), -3.333])
    clicks = [(rng.choice([None, i, i, i]), client(), time()) for i in range(n)]
    clicks += rng.sample([c for c in clicks if c[0] is not None], n // 5)
    return clicks, [(rng.choice([None, *[i] * 30]), client(), total(), time()) for i in range(n)]


@pytest.mark.parametrize("zone", ["timestamp_ntz", "timestamp"])
def test_matches_equal_brute_force(spark, zone):
    clicks, sales = shop(3, 400)
    a = spark.createDataFrame(clicks, "click_id long, client_id long, ts timestamp_ntz").withColumns({"key": F.lit("k"), "at": F.lit(1), "n_tied": F.lit(9)})
    b = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz").withColumn("turn", F.lit(3))
    a, b = a.withColumn("ts", F.col("ts").cast(zone)), b.withColumn("sold_at", F.col("sold_at").cast(zone))
    got = asof.click_orders(a, b)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_matches(clicks, sales)
    assert asof.click_orders(a.where("false"), b).count() == 0
    assert {(r.sale_id, r.n_tied) for r in asof.click_orders(a, b.where("false")).collect()} == {(None, 0)}


def test_times_without_a_zone_are_not_moved_by_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000001' as ts union all select timestamp_ntz'1969-12-31 23:59:59'")
        assert sorted(r.us for r in rows.select(asof.micros(rows, "ts").alias("us")).collect()) == [-1_000_000, 1_710_037_800_000_001]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_one_key_over_many_ranges_is_carried_by_levels(spark):
    """Orders of one client far before its clicks, so that most ranges have none, and more ranges than a task of the prefix scan takes."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        asks = spark.range(3000).select("id", F.lit(7).alias("k"), (F.col("id") % 1500 + 100).alias("at"))
        orders = spark.createDataFrame([(7, 90, 1), (7, 90, 2), (7, 1200, 3), (6, 5, 4), (8, 2000, 5)], "k long, at long, v long")
        got = {r.id: (r.lag, r.v, r.n_tied) for r in asof.as_of(asks, orders, "k", "at", "id", ["v"], 900, fan=3).collect()}
        want = {}
        for i in range(3000):
            at = i % 1500 + 100
            want[i] = (at - 1200, 3, 1) if at >= 1200 else (at - 90, 2, 2) if at <= 990 else (None, None, 0)
        assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_prefix_scan_by_blocks(spark):
    values = [None, 3, None, None, 5, None, None, None, None, 1, None, None]
    ends = spark.createDataFrame(list(enumerate(values)), "part long, last long")
    want, last = {}, None
    for i, v in enumerate(values):
        want[i], last = last, last if v is None else v
    for fan in (2, 3, 5, 1024):
        assert {r.part: r.carried for r in asof.carried_in(ends, len(values), fan).collect()} == want
