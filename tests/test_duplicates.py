"""Duplicate texts against a sequential search with difflib, in parts of few pairs, with odd rows and a crowded page."""

import difflib
import random
import time

import numpy as np
import pytest

from foliospark.operators import duplicates

ELEMENTS = "image_id long, element_id long, type string, text string, confidence double, left_x long, top_y long, right_x long, bottom_y long"
WORDS = "invoice number total totals due date page one the of and to in is for you it with on as".split()


def sequential(rows, similarity, overlap):
    """By page and element_id, each row joins the first seed that it resembles; then the most confident of each group."""
    def alike(a, b):
        if a[3] is not None and b[3] is not None and difflib.SequenceMatcher(None, a[3], b[3]).ratio() > similarity:
            return True
        if None in a[5:9] or None in b[5:9]:
            return False
        common = max(0, min(a[7], b[7]) - max(a[5], b[5])) * max(0, min(a[8], b[8]) - max(a[6], b[6]))
        areas = [(r[7] - r[5]) * (r[8] - r[6]) for r in (a, b)]
        return common / (min(areas) if all(areas) else 1) > overlap

    groups = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        seeds = groups.setdefault(r[0], [])
        own = next((g for g in seeds if alike(g[0], r)), None)
        if own is None:
            seeds.append([r])
        else:
            own.append(r)
    sure = lambda r: -1.0 if r[4] is None else r[4]
    return sorted((page, g[0][1], max(g, key=lambda r: (sure(r), -r[1]))[1], len(g)) for page, all_ in groups.items() for g in all_)


def edited(rng, text):
    out = list(text)
    for _ in range(rng.randrange(4)):
        if out and rng.random() < 0.5:
            out[rng.randrange(len(out))] = rng.choice("abé☃ ")
        out.insert(rng.randrange(len(out) + 1), rng.choice("xyz𝄞"))
    return "".join(out)


def some_rows(rng, n):
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) for _ in range(40)]
    texts = [edited(rng, rng.choice(pool)) for _ in range(n // 2)] + [None, "", "a", "x" * 300, "x" * 301, "ab" * 150]
    rows = []
    for i in range(n):
        left, top = rng.randrange(-50, 400), rng.randrange(-50, 400)
        box = (left, top, left + rng.choice([0, 20, 60]), top + rng.choice([0, 12, 30]))
        rows.append((rng.randrange(4), i, "text", rng.choice(texts), rng.choice([None, 0.5, rng.random()]), *(box if rng.random() > 0.05 else (None, *box[1:]))))
    return rows


@pytest.mark.parametrize("seed, similarity, overlap, pairs, many", [(1, 0.8, 0.5, 50, 3), (2, 0.8, 0.5, 1 << 20, 256), (3, 0.5, 0.9, 200, 10), (4, 0.95, 0.1, 1 << 20, 5), (5, 0.0, 0.5, 90, 256), (6, 1.0, 0.5, 1 << 20, 256)])
def test_groups_equal_a_sequential_search(spark, monkeypatch, seed, similarity, overlap, pairs, many):
    monkeypatch.setattr(duplicates, "PAIRS", pairs)
    monkeypatch.setattr(duplicates, "MANY", many)
    rows = some_rows(random.Random(seed), 220)
    df = spark.createDataFrame(rows, ELEMENTS).repartition(3)
    assert sorted(map(tuple, duplicates.without_duplicate_texts(df, similarity, overlap).collect())) == sequential(rows, similarity, overlap)


def test_filters_let_no_match_go():
    """The bounds hold for every pair that difflib finds above the threshold, autojunk of long texts included."""
    rng = random.Random(9)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 5, 60]))) for _ in range(12)]
    texts = [edited(rng, rng.choice(base)) for _ in range(90)]
    counts = duplicates._Texts(texts)
    for least in (0.3, 0.6, 0.8, 0.9):
        for i in range(len(texts)):
            j = np.arange(len(texts))
            passed = counts.may_exceed(np.array([i]), j, least)
            assert (counts.may_exceed(np.full(len(j), i), j, least) == passed).all()
            for k in j:
                if difflib.SequenceMatcher(None, texts[i], texts[k]).ratio() > least:
                    assert passed[k] and duplicates._exceeds(texts[i], texts[k], duplicates._Subsequences(texts[i]), least)


def test_common_subsequences():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for k, y in enumerate(b):
                row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc𝄞") for _ in range(rng.randrange(80))) for _ in range(2))
        assert duplicates._Subsequences(a).common(b) == plain(a, b)


def test_a_crowded_page():
    """10,000 texts of one page, a third of them one label and many at one place, in seconds."""
    rng = random.Random(7)
    n = 10_000
    texts = ["same label", *dict.fromkeys(f"{rng.choice(WORDS)} {rng.randrange(10**9)} {rng.choice(WORDS)} {i}" for i in range(n))]
    code = np.array([0 if i % 3 == 0 else i + 1 for i in range(n)])
    place = np.array([[rng.randrange(40_000), rng.randrange(90_000)] for _ in range(n)], float)
    began = time.time()
    owner = duplicates.leaders_of(np.zeros(n, np.int64), code, texts, np.concatenate((place, place + [150, 20]), axis=1), 0.8, 0.5)
    assert time.time() - began < 60
    assert len(set(owner[::3].tolist())) < 40 and (owner[::3] == 0).sum() > n / 3 - 60
