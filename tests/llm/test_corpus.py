"""Corpus operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliospark.functions import lineage
from foliospark.llm import mixing, neardup, packing, passages, quality, secretscan, simhash, tokencount, urlrules, warc
from foliospark.llm.components import components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i} of a very long text" for i in range(20_000))
#: Texts of every awkward kind, and a column with a name that operators use inside.
DOCS = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "s1"),
    (2, None, "s1"),
    (3, "", None),
    (4, " \n\t ", "s2"),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "s2"),
    (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "s2"),
    (None, "no id here, but a text", "s2"),
    (7, LONG, "s3"),
    (8, "one", "s3"),
    (9, "é ☃ 𝄞 naïve text\x00 with odd\x85 characters here", "s3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    clashing = {"kept": F.lit("x"), "size": F.lit(1), "key": F.lit("k"), "n": F.lit(None).cast("int"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")}
    return docs.withColumns(clashing)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# Mixing.


def brute_targets(sizes):
    """By plain shares: what sources above three times their size can't take goes to the others by weight."""
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(sorted(sizes, key=lambda n: (n is None, n or "")))}
    out, free, rest = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weight[n] for n in free)
        over = {n for n in free if rest * weight[n] / total > 3 * sizes[n]}
        for n in over or free:
            out[n] = 3.0 * sizes[n] if over else rest * weight[n] / total
        free, rest = (free - over, rest - sum(out[n] for n in over)) if over else (set(), 0)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 1, "c": 500}, {}, {"a": 0}, {**{f"s{i:03}": i * i % 97 for i in range(120)}, "é": 5, "z": 70, None: 3}])
def test_targets_stop_at_the_cap_and_share_the_rest(spark, sizes):
    from foliospark.functions.lineage import Scratch

    with Scratch(spark) as scratch:
        frame = spark.createDataFrame(list(sizes.items()), "source string, words long").repartition(7)
        got = {r.source: r for r in mixing.targets(frame, scratch).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[n].target, t, rel_tol=1e-12) for n, t in want.items())
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == sorted(sizes, key=lambda n: (n is None, n or ""))


def brute_multiplier(sizes, goal, cap=3):
    """By bisection."""
    mean, low, high = max(sum(sizes), 1) / len(sizes), -2000.0, 2000.0
    for _ in range(200):
        at = (low + high) / 2
        taken = sum(n * min(cap, math.exp(min(at * n / mean, 700))) for n in sizes)
        low, high = (at, high) if taken < goal else (low, at)
    return at / mean


def test_mixing_equals_brute_force(spark):
    """Rates by bisection; rounding misses a source by less than half its largest document for each group."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)) if rng.random() < 0.95 else None, rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(None, "one two three", "a"), (None, "one two three", "a"), ((1 << 53) + 1, "x y", "a"), ((1 << 53) + 3, "x y z", "a"), (None, None, None)]
    got = mixing.mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in got) == collections.Counter((i, s, len((t or "").split())) for i, t, s in rows)
    sizes = collections.defaultdict(list)
    for _, t, s in rows:
        sizes[s].append(len((t or "").split()))
    goals = brute_targets({s: sum(x) for s, x in sizes.items()})
    taken = collections.Counter()
    slope = {s: brute_multiplier(sizes[s], goals[s]) for s in sizes}
    for r in got:
        assert r.source_size == sum(sizes[r.source]) and math.isclose(r.target, goals[r.source], rel_tol=1e-9)
        if r["size"] and goals[r.source] < 3 * r.source_size:
            assert math.isclose(r.rate, min(3, math.exp(slope[r.source] * r["size"])), rel_tol=1e-4)
        assert r.taken == r.copies * r["size"] and abs(r.copies - r.rate) < 1 + 1e-9
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goals[s]) <= max(sizes[s]) / 2 + 1 for s in sizes)


def test_sources_that_do_not_converge_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing.multipliers, "__defaults__", (1e-7, 2))
    with pytest.raises(RuntimeError, match="sources have not come"):
        mixing.mixed_rows(docs)


def test_mixing_meets_targets_and_repeats(docs, texts):
    rows = mixing.mixed_rows(docs).collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, largest[s] / 2)
    again = {r.doc_id: r.taken for r in mixing.mixed_rows(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_rates_are_exponential_in_size(docs):
    rows = [r for r in mixing.mixed_rows(docs).collect() if r["size"] and 0 < r.rate < 3 - 1e-9]
    slopes = collections.defaultdict(list)
    for r in rows:
        slopes[r.source].append(math.log(r.rate) / r["size"])
    assert all(max(s) - min(s) < 1e-9 for s in slopes.values())


def test_mixing_of_odd_rows(spark, odd, none):
    rows = mixing.mixed_rows(odd).collect()
    assert len(rows) == len(DOCS)
    assert all(r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    big = spark.createDataFrame([((1 << 53) + 1, "some words of it", "s2"), ((1 << 53) + 3, "other words", "s2")], "doc_id long, text string, source string")
    own = {r.doc_id: r.copies for r in mixing.mixed_rows(odd.select("doc_id", "text", "source").union(big)).collect()}
    assert {(1 << 53) + 1, (1 << 53) + 3, None} < own.keys()
    clash = odd.withColumns({"copies": F.lit("c"), "K1": F.lit(1), "k2": F.lit(2), "turn": F.lit(0)})
    mixed = mixing.mixture(clash)
    assert mixed.columns == clash.columns
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +want
    assert mixing.mixed_rows(none).count() == mixing.mixture(none).count() == 0


# Quality.


def brute_quality(x):
    words, seen, dup = WORD.findall(x), set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in x), dup, len(inside)


def test_quality_equals_brute_force(docs, texts, odd):
    for got, want in ((by_id(quality.judged(docs)), texts), (by_id(quality.judged(odd)), {i: t or "" for i, t, _ in DOCS if i})):
        for i, x in want.items():
            r = got[i]
            figures = brute_quality(x)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures
            assert r.base_failed == (figures[0] < 20 or 100 * figures[4] > 30 * figures[0])
            assert not (r.base_failed and r.kept)


def test_quality_rejects_repetition_and_keeps_prose(spark, none):
    prose = " ".join(f"w{i}" for i in range(200))
    rows = [(1, prose), (2, " ".join(w for i in range(30) for w in [f"w{i}"] * 7)), (3, "\n".join(["the same line of words"] * 3 + [f"line {i}" for i in range(4)]) + " more")]
    got = by_id(quality.judged(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1].kept and not got[2].kept and not got[2].base_failed and not got[3].kept
    assert quality.judged(none).count() == quality.filtered(none).count() == 0


def test_quality_filter_keeps_columns(odd):
    kept = quality.filtered(odd)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 5]


# Near duplicates.


def brute_groups(texts, words):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [rng.choice("xyzuvw") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def near_copies(seed=3, n=120):
    """A large group of edited copies, some beyond the threshold from the first and near each other, and other texts."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(5000)}" for _ in range(90)]
    rows, drafts = {}, [base]
    for i in range(n):
        draft = edited(rng, rng.choice(drafts), rng.choice([0.01, 0.03, 0.06, 0.1]))
        if i % 10 == 0:
            drafts.append(draft)
        if i % 7 == 0:
            draft = draft[: rng.randrange(60, 90)]
        rows[i] = " ".join(draft)
    for i in range(n, n + 60):
        rows[i] = " ".join(f"u{rng.randrange(9000)}" for _ in range(rng.randrange(1, 60)))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, docs, texts, words):
    planted = near_copies()
    frame = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    for df, want in ((docs, texts), (frame, planted)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, words=words).collect()}
        assert got == brute_groups(want, words)


def test_links_that_a_star_misses(spark):
    """Blocks of one member and a star whose members are alike but unlike the hub."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(100)]
    far = edited(rng, base, 0.12)
    rows = {0: base, **{i: edited(rng, far, 0.02) for i in range(1, 25)}, **{i: edited(rng, base, 0.02) for i in range(25, 50)}}
    rows = {i: " ".join(w) for i, w in rows.items()}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    before, neardup.BLOCK_BYTES = neardup.BLOCK_BYTES, 2000
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, words=2).collect()}
    finally:
        neardup.BLOCK_BYTES = before
    assert got == brute_groups(rows, 2)


def near_misses(m, families, seed=1):
    """Differences from a hub of 100 hashes that m sets of a star have, none of which is linked with it: of some families, or each by itself."""
    rng, hub = np.random.default_rng(seed), np.arange(100)
    kinds = [np.concatenate([rng.choice(hub, 60, replace=False), rng.integers(10**6, 10**12, 40)]) for _ in range(families)]
    sets = []
    for j in range(m):
        own = (kinds[j % families] if families else hub).copy()
        k = rng.choice(100, rng.integers(1, 16) if families else 25, replace=False)
        own[k] = rng.integers(10**6, 10**12, len(k))
        sets.append(np.unique(own))
    both = range(2 * m)
    import pyarrow as pa

    group = pa.table(
        {
            "b": [j % m for j in both], "n": pa.array([len(sets[j % m]) for j in both], pa.int32()), "component": [j % m for j in both],
            "role": pa.array([j // m for j in both], pa.int32()), "delta": pa.array([np.setxor1d(sets[j % m], hub) for j in both], pa.list_(pa.int64())),
        }
    )
    return sets, group


def grouped(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("families", [0, 1, 5])
def test_links_of_a_block_equal_all_pairs(families):
    sets, group = near_misses(250, families)
    sets_ = [set(s.tolist()) for s in sets]
    want = [(i, j) for i in range(250) for j in range(i) if 10 * len(sets_[i] & sets_[j]) >= 8 * len(sets_[i] | sets_[j])]
    got = neardup._block_links(group, 0.8, 0.25)
    assert set(got) <= {p for a, b in want for p in ((a, b), (b, a))} and len(got) < 250
    assert grouped(250, got) == grouped(250, want)


def test_a_hub_of_many_near_misses():
    """Not all pairs: 20,000 members that are unlike the hub and each other."""
    import time

    _, group = near_misses(20_000, 0)
    began = time.process_time()
    assert neardup._block_links(group, 0.8, 0.25) == [] and time.process_time() - began < 60


def stars_of_few(hubs, seed=1):
    """(a, b, n, linked, delta) of hubs with 1 to 4 members that are unlike them, and the pairs of members with similarity 0.8 or more."""
    rng, rows, want = np.random.default_rng(seed), [], set()
    values = lambda k: rng.integers(-(2**63), 2**63 - 1, k)
    for a in range(0, 5 * hubs, 5):
        hub, sets = values(30), []
        for j in range(1 + a // 5 % 4):
            # Every third hub's later members are like the first one, up to a few hashes.
            own = np.concatenate((sets[0][j + 1 :], values(j + 1))) if j and a % 3 == 0 else np.concatenate((hub[:10], values(20)))
            want |= {(a + 1 + i, a + 1 + j) for i, s in enumerate(sets) if 10 * len(np.intersect1d(s, own)) >= 8 * len(np.union1d(s, own))}
            sets.append(own)
            rows.append((a, a + 1 + j, 30, False, np.sort(np.setxor1d(own, hub).view(np.uint64)).view(np.int64).tolist()))
    return rows, want


def test_links_in_stars_of_few_members_equal_all_pairs(spark):
    rows, want = stars_of_few(1000)
    stars = spark.createDataFrame(rows, "a long, b long, n int, linked boolean, delta array<long>")
    got = {tuple(sorted(r)) for r in neardup.missed(stars, 0.8).collect()}
    assert got == want and len(want) > 300


def test_small_blocks_are_looked_up_together(monkeypatch):
    """Small blocks across batches and passes have the links of all pairs, without a call for each block; a large block has its own."""
    import pyarrow as pa

    rows, want = stars_of_few(500)
    both = sorted((a, 0, 0, 0, 0, b, n, b, role, delta) for a, b, n, _, delta in rows for role in (0, 1))
    names = [*neardup.BLOCK_KEYS, "b", "n", "component", "role", "delta"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*both[i : i + 70])], names) for i in range(0, len(both), 70)]
    calls, whole = [], neardup._block_links
    monkeypatch.setattr(neardup, "_block_links", lambda group, *a: calls.append(group.num_rows) or whole(group, *a))

    def found():
        return {tuple(sorted(p.values())) for part in neardup._links_of_blocks(iter(batches), 0.8) for p in part.to_pylist()}

    assert found() == want and not calls
    monkeypatch.setattr(neardup, "PASS_PAIRS", 5)
    monkeypatch.setattr(neardup, "PASS_HASHES", 50)
    assert found() == want and not calls
    monkeypatch.setattr(neardup, "FEW_PAIRS", 4)
    assert grouped(2500, found()) == grouped(2500, want) and set(calls) == {6, 8}


def test_blocks_are_whole_across_batches():
    import pyarrow as pa

    for sizes in ([1], [3, 1, 1, 5], [1, 2, 9, 1, 1]):
        flat = np.repeat(np.arange(len(sizes)), sizes)
        for step in (1, 2, 4, 20):
            batches = [pa.RecordBatch.from_arrays([pa.array(flat[i : i + step])], ["k"]) for i in range(0, len(flat), step)]
            found = [np.split(rows.column("k").to_numpy(), starts[1:]) for rows, starts in neardup._groups(iter(batches), ["k"])]
            assert [x.tolist() for part in found for x in part] == [[k] * n for k, n in enumerate(sizes)]


def test_near_duplicates_of_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd, words=2).collect()
    assert len(rows) == len(DOCS)
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.component_id, r.kept))
    assert got[5] == {(1, False)} and got[1] == {(1, True)} and got[None] == {(None, True)}
    assert all(got[i] == {(i, True)} for i in (2, 3, 4, 7, 8, 9))
    clash = odd.withColumns({"rows": F.lit("r"), "__kept": F.lit(1)})
    kept = neardup.deduplicated(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert neardup.near_duplicates(none).count() == neardup.deduplicated(none).count() == 0


def test_a_repeated_id_stays_once(spark):
    frame = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.deduplicated(frame).collect()) == [1, 2]


def test_densified_slots_estimate_similarity():
    signer, rng = neardup.Signer(32, 5), np.random.default_rng(5)
    for size in (8, 40, 900):
        shares = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, size + size // 4, np.int64).astype(np.uint64) * np.uint64(2)
            a, b = np.sort(both[:size]), np.sort(both[size // 4 :])
            shares.append(np.mean(np.equal(*signer.slots(np.concatenate((a, b)), np.repeat([0, 1], size), 2))))
        assert abs(np.mean(shares) - (size - size // 4) / (size + size // 4)) < 0.06


def test_components_of_a_long_chain(spark):
    n = 40
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(50, 51), (51, 51), (50, 51)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 50, 51, 60]], "node long")
    got = {r.node: r.component for r in components(links, nodes).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 50: 50, 51: 50, 60: 60}


# Tokens.


def test_token_counts_equal_the_library(docs, texts, odd, none, monkeypatch):
    monkeypatch.setattr(tokencount, "PART", 64)
    counter = tokencount.Counter(public_tokenizers.path(tokencount.TOKENIZER))
    assert counter.splits
    rng = random.Random(4)
    mixed = ["".join(rng.choice("aB é ▁  \n.　 s<s></s>1\x00\t") for _ in range(rng.randrange(300))) for _ in range(500)]
    assert counter.counts(mixed).tolist() == [len(counter.model.encode(t)) for t in mixed]
    monkeypatch.undo()
    path = public_tokenizers.path(tokencount.TOKENIZER)
    for got, want in ((by_id(tokencount.token_counts(docs, path)), texts), (by_id(tokencount.token_counts(odd, path)), {i: t or "" for i, t, _ in DOCS if i})):
        for i, t in want.items():
            n = len(counter.model.encode(t))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)
    assert tokencount.token_counts(none, path).count() == 0


def test_token_counts_by_the_other_library(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = by_id(tokencount.token_counts(odd, path, limit=10))
    assert got[9].n_tokens == len(plain.encode(DOCS[9][1], add_special_tokens=False).ids) and got[7].over_limit and got[2].n_tokens == 0


# WARC.


PAGES = [(1, "http://a.example/", "<p>one</p>"), (2, "http://b.example/\r\nX: y", "<p>one</p>"), (3, None, None), (4, "http://d.example/", ""), (5, "http://e.example/", "é☃" * 50_000), (6, "x", "<p>one</p>"), (None, "http://n.example/", "<p>only</p>")]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "sha256": F.lit("x")})
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    assert len(got) == len(PAGES)
    groups = collections.defaultdict(list)
    for i, _, html in PAGES:
        groups[html or ""].append(i)
    for i, _, html in PAGES:
        body, owner = (html or "").encode(), max(groups[html or ""], key=lambda p: -1 if p is None else p)
        first = i == owner
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first else ("revisit", owner))
    warc.write_archive(pages, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len(groups)
    for r in warc.records(spark, str(tmp_path / "w")).collect():
        raw = bytes(r.record)
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        block = block[:-4]
        assert int(fields["Content-Length"]) == len(block)
        if fields["WARC-Type"] == "response":
            body = block.partition(b"\r\n\r\n")[2]
            assert body == (next(h for i, _, h in PAGES if i == r.page_id) or "").encode()
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert "WARC-Refers-To" in fields


def test_archive_options_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "x" * 20), (4, "d", "x" * 20)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archived(pages, min_bytes=10).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.archived(pages.where("false")).count() == 0
    warc.write_archive(pages, str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w/payloads")).withColumn("payload", F.lit(b"other"))
    stored.write.parquet(str(tmp_path / "v/payloads"))
    spark.read.parquet(str(tmp_path / "w/heads")).write.parquet(str(tmp_path / "v/heads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "v")).select("payload_digest").collect()


# SimHash.


def test_edited_texts_and_likeness(spark, docs, texts):
    got = by_id(simhash.edited_likeness(docs))
    ids = sorted(texts)
    for k, i in enumerate(ids):
        after = ids[(k + 1) % len(ids)]
        half = len(texts[i]) // 2
        other = texts[i][: len(texts[i]) - half] + texts[after][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(texts[i]), hashlib.sha256(other.encode()).hexdigest())
        apart = bin(int(got[i].fingerprint, 16) ^ int(got[after].fingerprint, 16)).count("1")
        assert got[i].near_next == 1 - apart / 64
    assert sum(got[i].near_edited for i in ids) > sum(got[i].near_next for i in ids) + 0.1 * len(ids)
    prints = {int(got[i].fingerprint, 16) for i in ids}
    for i in ids:
        own = int(got[i].fingerprint, 16)
        near = sum(p != own and bin(p ^ own).count("1") <= 3 for p in prints)
        assert got[i].near_fingerprints == (None if i % 50 else near)
    same = collections.defaultdict(set)
    for i in ids:
        same[texts[i]].add(got[i].fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_fingerprints_equal_a_vote(spark):
    rows = [(1, "alpha beta beta  to of\nthe"), (2, ""), (3, " \n"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(simhash.fingerprints(df, ["doc_id"]))
    words = sorted({w for _, t in rows for w in WORD.findall(t)})
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for i, t in rows:
        want = 0
        weights = [(hashes[w] % (1 << 64), min(max(len(w) - 2, 1), 7)) for w in WORD.findall(t)]
        for bit in range(64):
            if 2 * sum(n for h, n in weights if h >> bit & 1) > sum(n for _, n in weights):
                want |= 1 << bit
        assert got[i].fingerprint % (1 << 64) == want


def test_ranges_hand_over_their_first_row(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 4)
    df = spark.createDataFrame([(i, f"t{i}") for i in random.Random(3).sample(range(500), 100)], "doc_id long, text string")
    rows = simhash.in_ranges(df, rows=7)
    least = {r.range: (r.low, r.high) for r in rows.groupBy("range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}
    assert len(least) > 10 and all(least[a][1] < least[b][0] for a, b in zip(sorted(least), sorted(least)[1:]))
    got = {r.doc_id: r.after for r in simhash.with_next(rows, {"text": "after"}, ["doc_id", "text"]).collect()}
    ids = sorted(got)
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.edited_likeness(odd).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, _, _ in DOCS)
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert simhash.edited_likeness(none).count() == 0


def test_neighbours_are_all_within_the_radius(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in [*signed, None]], "fingerprint long")
    asked = df.limit(40)
    got = {(r.fingerprint, r.near): r.distance for r in simhash.neighbours(df, asked, radius=3).collect()}
    far = lambda a, b: bin((a ^ b) % (1 << 64)).count("1")
    queries = [r.fingerprint for r in asked.collect() if r.fingerprint is not None]
    assert got == {(a, b): far(a, b) for a in queries for b in signed if a != b and far(a, b) <= 3}


# Secrets.


def test_secret_scan_equals_plain_patterns(docs, texts):
    got = by_id(secretscan.scanned(docs))
    assign = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in texts.items():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        told = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()


def named(text):
    return [text[a:b] for k, a, b, _ in secretscan.spans(text) if k == 3]


def test_assignments_reach_sensitive_names():
    assert named('db_pwd = "Tr0ub4dor&3x"') == ["Tr0ub4dor&3x"]
    assert named('k = "q8Zr!2mNv"\nDB_PASSPHRASE = k') == ["q8Zr!2mNv"]
    assert named('a = "q8Zr!2"\nb = "mNv7"\nclientSecret := a + b') == ["q8Zr!2", "mNv7"]
    assert named("private_key: zX9-ab_Q2.m7") == ["zX9-ab_Q2.m7"]
    assert named('{"accessKey": "w7Pq+81/xZ"}') == ["w7Pq+81/xZ"]
    for clean in ("token_count = 123456789", "password_hint = 'Blue42Sky!'", "the secret: nobody knows it", "pwd = '${DB_PASSWORD}'", "auth: changeme123", "note: see chapter 12", 'pwd = ""'):
        assert named(clean) == []


def test_assignments_of_any_length():
    key = "".join(f"Zk{i}q" for i in range(2000))
    assert named("db_pass = 'hunter2abc99'") and named("auth: 'hunter2abc99'")
    assert named(f"passphrase = '{key}'") == [key]
    assert named(f"{'long_' * 40}pwd = 'hunter2abc99'") == ["hunter2abc99"]


SYNTAX = {
    "typed": lambda n, a, b: (f'{n}: str = "{a}{b}"', [a + b]),
    "generic": lambda n, a, b: (f"{n}: Optional[List[str]] = '{a}{b}'", [a + b]),
    "union": lambda n, a, b: (f"{n}: str | None = '{a}{b}'", [a + b]),
    "brackets": lambda n, a, b: (f'{n} = ("{a}" + "{b}")', [a, b]),
    "adjacent": lambda n, a, b: (f"{n} = (  # it's said here\n    '{a}'\n    '{b}'\n)", [a, b]),
    "triple": lambda n, a, b: (f'{n} = """\n{a}{b}\n"""', [a + b]),
    "format": lambda n, a, b: (f'{n} = f"{a}{b}"', [a + b]),
    "filled": lambda n, a, b: (f'part_ = "{a}"\n{n} = f"{{part_}}{b}"', [a, f"{{part_}}{b}"]),
    "continued": lambda n, a, b: (f'{n} = \\\n    "{a}{b}"', [a + b]),
    "block comment": lambda n, a, b: (f"{n} = ( /* two\nlines */ '{a}{b}')", [a + b]),
    "element": lambda n, a, b: (f"<{n}>{a}{b}</{n}>", [a + b]),
    "attribute": lambda n, a, b: (f'<entry key="{n}" value="{a}{b}"/>', [a + b]),
    "subscript": lambda n, a, b: (f'conf["{n}"] = "{a}{b}"', [a + b]),
    "array": lambda n, a, b: (f'char {n}[] = "{a}{b}";', [a + b]),
    "option": lambda n, a, b: (f"run --{n}={a}{b} now", [a + b]),
    "json": lambda n, a, b: (f'{{"{n}" : "{a}{b}"}}', [a + b]),
    "hash": lambda n, a, b: (f":{n} => '{a}{b}'", [a + b]),
    "dots": lambda n, a, b: (f"${n} = '{a}' . '{b}';", [a, b]),
    "back quotes": lambda n, a, b: (f"const {n} = `{a}{b}`;", [a + b]),
    "appended": lambda n, a, b: (f'{n} = "{a[:4]}"\n{n} += "{a[4:]}{b}"', [a[:4], a[4:] + b]),
    "block": lambda n, a, b: (f"  {n}: |\n    {a}\n    {b}\n  next: 1", [f"{a}\n    {b}"]),
    "wrapped": lambda n, a, b: (f'{n} = SecretStr("{a}{b}")', [a + b]),
    "argument": lambda n, a, b: (f"connect(user='me', {n}='{a}{b}')", [a + b]),
    "through names": lambda n, a, b: (f'one_ = "{a}"\ntwo_ = "{b}"\nboth_ = one_ + two_\n{n} := both_', [a, b]),
    "yaml": lambda n, a, b: (f"{n}: {a}{b}", [a + b]),
    "prose": lambda n, a, b: (f"note: it's {n}'s own\nsome {n} here", []),
    "unknown": lambda n, a, b: (f"{n} = other.name", []),
    "call": lambda n, a, b: (f'{n} = os.getenv("{n.upper()}")', []),
    "placeholder": lambda n, a, b: (f"{n} = '${{{n.upper()}}}'", []),
    "compared": lambda n, a, b: (f'if {n} == "{a}{b}":', []),
    "several": lambda n, a, b: (f"user_, {n} = 'me', '{a}{b}'", [a + b]),
    "declared": lambda n, a, b: (f'var {n} string = "{a}{b}"', [a + b]),
    "list": lambda n, a, b: (f'{n}s = ["{a}{a}", "{b}{b}"]', [a + a, b + b]),
    "or": lambda n, a, b: (f'{n} = env.get("X_") or "{a}{b}"', [a + b]),
    "default": lambda n, a, b: (f'{n} = getenv("X_", "{a}{b}")', [a + b]),
    "later": lambda n, a, b: (f"{n} = later_{n}_x\nlater_{n}_x = '{a}{b}'", [a + b]),
    "outer block": lambda n, a, b: (f"  {n}:|\n    {n}:|\n      {a}{b}\n  next: 1", [a + b]),
    "not sensitive": lambda n, a, b: (f'colour_ = "{a}{b}"', []),
}


@pytest.mark.parametrize("seed", range(8))
def test_assignments_of_a_grammar(seed):
    """Programs put together from statements, whose literals are known."""
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice(s) for s in ("QRSTUVW", "ghijkmno", "23456789", "QRSTUVW", "ghijkmno", "23456789"))
    lines, want = [], []
    for kind in rng.sample(sorted(SYNTAX), len(SYNTAX)):
        line, literals = SYNTAX[kind](rng.choice(["db_pwd", "dbPassphrase", "client_credential", "signing_key", "smtp_pass"]), part(), part())
        lines.append(line)
        want += literals
    assert named("\n".join(lines) + "\n") == want


LINEAR = ["ab:", "a:b|", "a=[b,", "a=['b',", "a=['a=',", "x,", "a=b(", "a=b('c',", "env('a',", "a=b or ", "a=b\nb=a\n", "x = (/*", "x = ( # ", "a: b[", "x = (#\n", "a-", "'", "<a", "a = `", "a = \'\'\'", "pwd = a|", "a: |\n", "x = (\n"]


@pytest.mark.parametrize("text", [x * 40_000 for x in LINEAR] + ["a = 'Zx9q!2mN'\n" + "a = a + a\n" * 20_000 + "auth = a"])
def test_scans_take_linear_time(text):
    import time

    began = time.process_time()
    secretscan.spans(text)
    assert time.process_time() - began < 5


def test_macros_and_calls_name_their_values():
    text = '#define DB_PASSWD "Zx9q!2mNa"\ndefine(\'DB_PWD\', \'Yx9q!2mNb\');\ngetenv("SMTP_PWD", "Wx9q!2mNc")\ndefine("COLOUR", "Vx9q!2mNd")'
    assert sorted(named(text)) == ["Wx9q!2mNc", "Yx9q!2mNb", "Zx9q!2mNa"]


def test_nested_blocks_take_linear_time():
    import time

    for deep in ("".join(" " * k + "pwd:|\n" for k in range(1400)), "".join(" " * (k % 300) + "pwd:|\n" for k in range(7000)), " pwd:|\n" * 150_000):
        began = time.process_time()
        secretscan.spans(deep + "x")
        assert len(deep) > 900_000 and time.process_time() - began < 5
    assert named("a:|\n  pwd:|\n\n    Zx9q!2mNa\n  other: 1\n") == ["Zx9q!2mNa"]


def test_chains_of_sums_reach_all_their_literals():
    text = "a = 'Zx9q!2mN'\n" + "a = a + a\n" * 1000 + "auth = a\npwd = a"
    assert named(text) == ["Zx9q!2mN"]
    text = "a0 = 'Zx9q!2mN'\n" + "".join(f"a{i} = a{i - 1} + 'q{i}Z'\n" for i in range(1, 500)) + "auth = a499"
    assert len(named(text)) == 500


def test_base_spans_consume_as_defined():
    assert secretscan.digest(secretscan.spans("password=secret: abcdefghijklmnop")) == ""
    assert secretscan.digest(secretscan.spans("PassWord = 'abcdefghijkl'")) == "assign:0:24"
    assert secretscan.spans("to\u212aen=abcdefghijklmnop") == []
    assert [s[:3] for s in secretscan.spans("é AKIA" + "A" * 14 + " " + "0f" * 8)] == [(1, 2, 20), (2, 21, 37)]


def test_redaction(spark, odd, none):
    assert secretscan.redact("api_key='abcdefghijkl' ok") == "api_key='[SECRET]' ok"
    assert secretscan.redact("token=" + "0f" * 10 + "!") == "token=[SECRET]!"
    rows = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit("x token=abcdefghijklmnop")}))
    got = collections.defaultdict(list)
    for r in secretscan.redacted(rows).collect():
        got[r.doc_id].append(r)
    assert (got[99][0].text, got[99][0].n_chars) == ("x token=[SECRET]", 16)
    assert got[7][0].text == LONG and got[2][0].text is None and len(got[5]) == 2
    assert secretscan.redacted(odd).schema == odd.schema
    assert secretscan.scanned(odd).count() == len(DOCS) and secretscan.scanned(none).count() == secretscan.redacted(none).count() == 0


# Packing.


def test_chunked_ids_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    plain, known, rng = Tokenizer.from_file(path), packing.ChunkIds(path, limit=50), random.Random(1)
    rows = ["".join(rng.choice("aBé É÷×'<>|1 \n., ßñÿ́Ω s re ll\x00\x85") for _ in range(rng.randrange(60))) for _ in range(3000)]
    rows += ["Foo's İSTANBUL ΟΔΟΣ ΟΔΟΣ.x <|endoftext|>x<|startoftext|> don't 's'll", "", None, LONG]
    for k in range(0, len(rows), 700):
        ids, at = known.encode(pa.array(rows[k : k + 700]))
        for t, a, b in zip(rows[k : k + 700], at, at[1:]):
            assert plain.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist()


def check_packing(rows, capacity=packing.Capacities()):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(places) <= capacity.documents
        assert sum(n * n for _, n in places) <= capacity.attention or len(places) == 1
    return len(bins)


def test_packed_documents(docs, texts, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    plain = Tokenizer.from_file(path)
    rows = packing.packed_documents(docs, path).collect()
    assert check_packing(rows) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(k, k * 2048) for k in range(-(-len(ids) // 2048))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own) and sum(r.length for r in own) == len(ids)
    rows = packing.packed_documents(odd, path).collect()
    check_packing(rows)
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(i for i, _, _ in DOCS)
    assert packing.packed_documents(none, path).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_keeps_every_constraint(spark, score):
    capacity = packing.Capacities(tokens=100, documents=4, attention=4000, weights=(1.0, 0.5, 0.5), score=score)
    rng = random.Random(3)
    items = spark.createDataFrame([(i, rng.randrange(1, 60)) for i in range(300)], "doc_id long, length long")
    rows = packing.packed(items, capacity, group=60).collect()
    assert sorted(r.doc_id for r in rows) == list(range(300))
    assert check_packing(rows, capacity) <= 150


def brute_best_fit(lengths, capacity):
    """Bins one by one, in exact fractions."""
    from fractions import Fraction

    bins, out = [], []
    whole = (capacity.tokens, capacity.documents, capacity.attention)
    for n in lengths:
        demand = (n, 1, n * n)
        scores = []
        for b, room in enumerate(bins):
            if all(r >= d for r, d in zip(room, demand)):
                after = [Fraction(r - d, c) for r, d, c in zip(room, demand, whole)]
                if capacity.score == "norm":
                    scores.append((sum(w * float(x) ** 2 for w, x in zip(capacity.weights, after)), b))
                else:
                    scores.append((-sum(w * d / c * r / c for w, d, r, c in zip(capacity.weights, demand, room, whole)), b))
        if scores:
            least = min(scores)[0]
            best = min(b for x, b in scores if x <= least + 1e-12)
        else:
            best = len(bins)
            bins.append(list(whole))
        bins[best] = [r - d for r, d in zip(bins[best], demand)]
        out.append(best)
    return out


def test_best_fit_equals_a_plain_scan():
    rng = np.random.default_rng(4)
    lengths = np.sort(np.concatenate((rng.integers(1, 2048, 300), rng.integers(1, 30, 400))))[::-1]
    made = {}
    for name, capacity in {
        "default": packing.Capacities(), "dot": packing.Capacities(score="dot"), "tokens": packing.Capacities(weights=(1.0, 0.0, 0.0)),
        "few": packing.Capacities(documents=3), "cheap": packing.Capacities(attention=1 << 20), "documents": packing.Capacities(weights=(0.1, 1.0, 0.0)),
    }.items():
        made[name] = packing.best_fit(lengths, capacity)
        want = brute_best_fit(lengths.tolist(), capacity)
        # Sums of rounded shares may order bins that are nearly alike either way; how many there are doesn't depend on it.
        assert np.mean(made[name] == want) > 0.9 and abs(int(made[name].max()) - max(want)) <= 1, name
    assert any((made["default"] != made[k]).any() for k in ("tokens",)) and (made["default"] != made["dot"]).any()
    assert made["few"].max() > made["default"].max() and made["documents"].tolist() != made["default"].tolist()


def test_many_tiny_documents_make_no_sequence_more_than_needed(spark):
    assert packing.best_fit(np.ones(2048, np.int64), packing.Capacities()).max() == 0
    empty = spark.createDataFrame([(i, "") for i in range(2048)], "doc_id long, text string")
    got = packing.packed_documents(empty, public_tokenizers.path(packing.TOKENIZER)).collect()
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got) == list(range(2048))
    # A caller's own bound of documents binds.
    bins = packing.best_fit(np.ones(3000, np.int64), packing.Capacities(documents=1024))
    assert np.bincount(bins).tolist() == [1024, 1024, 952]


def test_packing_keeps_ids_and_repeated_rows(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    plain = Tokenizer.from_file(path)
    rows = [(None, "a null id"), ((1 << 53) + 1, "word " * 5000), ((1 << 53) + 3, None), (None, "a null id"), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sequence_id": F.lit(1), "offset": F.lit("x"), "length": F.lit(0)})
    got = packing.packed_documents(frame, path, with_ids=True).collect()
    check_packing(got)
    want = collections.Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, k, tuple(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r.doc_id, r.piece, tuple(r.ids)) for r in got) == want
    with pytest.raises(ValueError):
        packing.packed(frame)


def test_equal_rows_are_spread_over_groups(spark):
    items = spark.createDataFrame([(None, 3)] * 500, "doc_id long, length long")
    rows = packing.packed(items, packing.Capacities(tokens=7), group=50).collect()
    assert len(rows) == 500 and len({r.sequence_id >> 32 for r in rows}) > 5 and check_packing(rows, packing.Capacities(tokens=7)) <= 260


# URL rules.


def test_url_rules_equal_a_plain_search(spark):
    rng = random.Random(7)
    labels = ["com", "example", "a", "b-c", "x,y", "a!b", "net"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))
    rules = list({(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"{rng.choice(['http', 'ftp'])}://{host().upper() if rng.random() < 0.3 else host()}{path()}{rng.choice(['', '?q=/', '#://'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "://com/", "http://com", "http://.com./a", "http://com:80/a", "x\ny://com/a\nb", "http://É.com/a"] + [urls[0]] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"key": F.lit(1), "stack": F.lit(2), "host": F.lit("h")})
    told = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r for r in urlrules.judged(pages, told).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        h = p = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u[u.index("://") + 3 :], re.S)
            h, p = m[1].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), m[2]
        fits = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (h, p, best[2], best[3]), u


def test_a_host_of_many_path_rules(spark):
    """Nested and neighbouring path rules of one host, a hot url, and a sweep of several ranges."""
    rng = random.Random(9)
    paths = {"/" + "".join(rng.choice("abcé/") for _ in range(rng.randrange(12))) for _ in range(30_000)}
    rules = [("h.com", p, "block" if hash(p) % 2 else "allow") for p in paths] + [("com", "/a", "block")]
    urls = [f"http://{rng.choice(['h.com', 'x.h.com', 'g.com'])}/" + "".join(rng.choice("abcé/") for _ in range(rng.randrange(16))) for _ in range(2000)] + ["http://h.com/abc"] * 3000
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    verdict = {(h, p): v for h, p, v in rules}
    for i, u in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fits = [(len(h + path[:n]), len(h), h + path[:n], verdict[h, path[:n]]) for h in ("h.com", "com") if host == h or host.endswith("." + h) for n in range(len(path) + 1) if (h, path[:n]) in verdict]
        assert got[i] == max(fits, default=(0, 0, None, "allow"))[2:], u


def test_rules_nested_6000_deep(spark):
    """Each rule begins the next; urls leave the nest at every depth, and rules without any nesting stand beside it."""
    depth = 6000
    deep = spark.range(1, depth + 1).selectExpr("'h.com' as host", "'/' || repeat('a', int(id)) as path", "if(id % 2 = 0, 'block', 'allow') as verdict")
    flat = spark.range(3000).selectExpr("'h.com' as host", "'/b' || id as path", "'block' as verdict")
    pages = spark.range(300).selectExpr("id as page_id", "'http://h.com/' || repeat('a', int(id * 20)) || if(id % 3 = 0, 'b', 'Z') as url")
    began = time.monotonic()
    got = {r.page_id: r for r in urlrules.judged(pages, deep.union(flat)).selectExpr("page_id", "length(rule) as n", "verdict").collect()}
    assert time.monotonic() - began < 60
    assert got[0].n is None and all(got[i].n == len("h.com/") + 20 * i and got[i].verdict == "block" for i in range(1, 300))


def test_url_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in urlrules.judged(pages, none).collect()] == ["allow"] * 3
    assert urlrules.judged(pages.where("false"), none).count() == 0


def test_native_operators_use_no_python(spark, docs):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string").coalesce(1)
    with lineage.Scratch(spark) as scratch:
        urls = pages.select(urlrules.host_of(F.col("url")).alias("host"), urlrules.path_of(F.col("url")).alias("path"))
        hosts = urls.select("host").withColumn("key", urlrules.host_key(F.col("host")))
        made = urlrules.swept(hosts, urlrules.host_events(rules), ["key"], "stack", scratch)
        deep = urlrules.swept(urls.select(F.col("host").alias("rule_host"), F.col("path").cast("binary").alias("at")), urlrules.path_events(rules, scratch), ["rule_host", "at"], "active", scratch)
    for df in (made, deep, simhash.with_next(simhash.in_ranges(docs), {"text": "t"}, ["doc_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Passages.


def test_planted_passages_are_found(spark, docs, texts):
    rng = random.Random(12)
    syllables = ["ka", "lo", "mi", "ter", "san", "vo", "pel", "dru"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(9, 15))).capitalize() + "."
    text_ = lambda n: " ".join(sentence() for _ in range(n))
    passage, rows = [text_(6) for _ in range(5)], {}
    for i in range(60):
        words = text_(10).split(" ")
        at = rng.randrange(len(words))
        if i < 40:
            words[at:at] = [passage[i % 5].replace(" ", "\n", 1) if i % 3 == 0 else passage[i % 5]]
        rows[i] = " ".join(words)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = passages.repeated_passages(frame).collect()
    assert {r.doc_id for r in found} == set(range(40))
    # A first sentence that goes on from the words before it can be in a group of its own, with another keeper.
    assert {r.doc_id for r in found if r.removed} == set(range(5, 40))
    for r in found:
        part = " ".join(rows[r.doc_id][r.begin : r.end].lower().split())
        assert r.passage_words >= passages.RUN and len(part.split()) == r.n_words
        if part.endswith("."):
            assert part.split(" ", 4)[-1] in " ".join(rows[r.keeper_doc_id].lower().split())
    left = by_id(passages.without_repeats(frame))
    assert all(left[i].text == rows[i] for i in (*range(5), *range(40, 60)))
    assert all(len(left[i].text.split()) < len(rows[i].split()) - 30 for i in range(5, 40))


def test_near_passages_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    other = [*words[:30], "changed", *words[31:]]
    rows = [(1, "Before it all. " + " ".join(words) + ". After."), (2, "Else. " + " ".join(other) + ". End of it."), (3, "nothing of the kind " * 9)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.7).collect()
    assert {(r.doc_id, r.removed) for r in found} == {(1, False), (2, True)}


def test_passages_of_odd_rows(odd, none):
    found = passages.repeated_passages(odd, run=20).collect()
    assert {(r.doc_id, r.removed) for r in found} == {(1, False), (5, True)}
    clash = odd.withColumns({"doc": F.lit("d"), "Spans": F.lit(1)})
    left = passages.without_repeats(clash, run=20)
    assert left.columns == clash.columns and left.count() == len(DOCS)
    assert passages.repeated_passages(none).count() == passages.without_repeats(none).count() == 0


def exact_stretches(a, b, least):
    """(begin in a, begin in b, words) of the longest common stretches of two word lists, least words or more."""
    at = collections.defaultdict(list)
    for j in range(len(b)):
        at[tuple(b[j : j + least])].append(j)
    for i in range(len(a) - least + 1):
        for j in at.get(tuple(a[i : i + least]), ()):
            if not (i and j and a[i - 1] == b[j - 1]):
                n = least
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                yield i, j, n


def test_stretches_are_found_to_their_edges_whatever_the_sentences(spark):
    rng = random.Random(31)
    own = lambda n: [f"x{rng.randrange(10**6)}" + "." * (rng.random() < 0.1) for _ in range(n)]
    rows = {}
    # No sentence end in a passage, one in its middle, several; from 30 words to 70; 29 words are too few.
    for k, n in enumerate((30, 31, 40, 55, 70, 29)):
        passage = [w.rstrip(".") for w in own(n)] if k % 2 else own(n)
        passage[n // 2] += "." * (k == 3)
        for i in range(3):
            rows[10 * k + i] = [*own(rng.randrange(20)), "loose", *(f"{i}y{j}" for j in range(i)), *passage, f"{i}z", *own(rng.randrange(20))]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    covered = {i: set() for i in rows}
    for r in passages.repeated_passages(frame).collect():
        before = len(" ".join(rows[r.doc_id])[: r.begin].split())
        covered[r.doc_id] |= set(range(before, before + r.n_words))
    want = {i: {x for o in rows if o != i for a, _, n in exact_stretches(rows[i], rows[o], 30) for x in range(a, a + n)} for i in rows}
    assert covered == want and sum(map(bool, want.values())) == 15 and not any(covered[50 + i] for i in range(3))


def test_near_passages_that_a_star_misses(spark):
    """Triples of which two are alike and the third, often the hub, is unlike both; buckets of a single slot."""
    rows = {}
    for k in range(40):
        base = [f"t{k}n{i}" for i in range(60)]
        for i, words in enumerate(([*base[:40], *(f"h{k}n{j}" for j in range(30))], base, [*base[:58], f"e{k}", "end"])):
            rows[3 * k + i] = " ".join(words)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, x.split()) for i, x in rows.items())}
    key = {r.doc_id: bytes(r["keys"]) for r in passages.paragraphs(frame, 1, 1).collect()}
    alike = lambda a, b: key[a] == key[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    want = {(x, 3 * k + 1) for k in range(40) if alike(3 * k + 1, 3 * k + 2) for x in (3 * k + 1, 3 * k + 2)}
    found = passages.repeated_passages(frame, bands=1, rows=1).where("unit is not null").collect()
    assert {(r.doc_id, r.keeper_doc_id) for r in found} == want and len(want) > 60


def test_passages_of_short_lines(spark):
    lines = [f"v{i}a v{i}b v{i}c v{i}d" for i in range(24)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, "\n".join(["one two three", "four five", "six."])), (4, "seven.\neight nine ten eleven twelve\nend."), (5, "\n".join(["too few"] * 3))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    units = collections.defaultdict(list)
    for r in passages.paragraphs(frame).sort("doc_id", "unit").collect():
        units[r.doc_id].append((r.unit, r.word, r.n_words))
    assert units[1] == units[2] == [(i, 8 * i, 8) for i in range(12)]
    assert (units[3], units[4], units[5]) == ([(0, 0, 6)], [(0, 1, 5)], [(0, 0, 6)])
    verse = [(7, "\n".join(lines)), (8, "\n".join([*lines[:8], "a line", *lines[8:]]))]
    found = passages.repeated_passages(spark.createDataFrame(verse, "doc_id long, text string")).where("unit is not null").collect()
    assert {(r.doc_id, r.removed) for r in found} == {(7, False), (8, True)}


def test_near_passages_of_eight_words(spark):
    rows = []
    for k in range(20):
        words = [f"k{k}w{i}" for i in range(8)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(["loose", *words]))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), run=8).where("unit is not null").collect()
    assert {(r.doc_id, r.keeper_doc_id) for r in found} == {(i, i - i % 2) for i in range(40)}


def test_classes_are_counted_once(spark, docs):
    """Groups are read from a kept table: not again from all paragraphs, as often as they are used."""
    with lineage.Scratch(spark) as scratch:
        units = scratch.keep(passages.paragraphs(docs))
        of = scratch.keep(passages._linked(units, scratch, passages.buckets_for(docs), 0.8))
        labels = passages._groups(units, of, scratch)
        assert labels.count() and set(labels.inputFiles()).isdisjoint(units.inputFiles())


def test_linked_paragraphs_equal_all_pairs(spark):
    """Of all pairs of unlike paragraphs with similarity 0.8 or more, found by an index of all shingles, nearly all are in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    with lineage.Scratch(spark) as scratch:
        units = scratch.keep(passages.paragraphs(docs))
        of = {r["class"]: r.component for r in passages._linked(units, scratch, passages.buckets_for(docs), 0.8).collect()}
        texts = {r["class"]: r.text for r in units.where("text is not null").select("class", "text").collect()}
    sets, at = {}, collections.defaultdict(list)
    for c, t in texts.items():
        w = WORD.findall(t)
        sets[c] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for g in sets[c]:
            at[g].append(c)
    pairs = collections.Counter()
    for owners in at.values():
        if len(owners) > 1:
            pairs.update((a, b) for i, a in enumerate(owners) for b in owners[:i])
    want = [(a, b) for (a, b), n in pairs.items() if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    joined = sum(a in of and of[a] == of.get(b) for a, b in want)
    assert len(want) > 300 and joined >= 0.99 * len(want)
    # And nothing else is joined: components are those of the pairs.
    names = sorted(of)
    number = {c: k for k, c in enumerate(names)}
    groups = grouped(len(names), [(number[a], number[b]) for a, b in want if a in number and b in number])
    assert all((of[a] == of[b]) <= (groups[number[a]] == groups[number[b]]) for a, b in zip(names, sorted(names, key=lambda c: of[c])[1:]) if a != b)


def brute_passages(rows, run):
    """Words of each text inside stretches of run words or more that it shares with another."""
    return {i: {x for o in rows if o != i for a, _, n in exact_stretches(rows[i], rows[o], run) for x in range(a, a + n)} for i in rows}


def test_repeated_passages_equal_brute_force(spark):
    """Texts put together from a few shared stretches, of any length and place, in one line without sentence ends: what is found is what is shared."""
    rng = random.Random(17)
    pool = [[f"p{k}w{j}" for j in range(rng.randrange(10, 90))] for k in range(8)]
    rows = {}
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"o{i}n{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.6:
                part = rng.choice(pool)
                a = rng.randrange(len(part))
                words += part[a : a + rng.randrange(1, 70)]
        rows[i] = words
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string"))
    covered = {i: set() for i in rows}
    for r in found.collect():
        before = len(" ".join(rows[r.doc_id])[: r.begin].split())
        covered[r.doc_id] |= set(range(before, before + r.n_words))
    assert covered == brute_passages(rows, passages.RUN) and sum(map(len, covered.values())) > 500


def test_without_repeats_keeps_every_unshared_word(spark):
    """Pairs that share forty words; texts of twenty words of one document and twenty of another share no thirty words with either."""
    rng = random.Random(5)
    rows = {}
    for k in range(1500):
        shared = [f"s{k}n{j}" for j in range(40)]
        for i in range(2):
            rows[2 * k + i] = [*(f"a{rng.randrange(10**7)}" for _ in range(rng.randrange(1, 20))), *shared, *(f"b{rng.randrange(10**7)}" for _ in range(rng.randrange(1, 20)))]
    for k in range(100):
        rows[3000 + 3 * k], rows[3001 + 3 * k] = ([f"{c}{k}n{j}" for j in range(60)] for c in "cd")
        rows[3002 + 3 * k] = rows[3000 + 3 * k][10:30] + rows[3001 + 3 * k][20:40]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    left = {i: r.text.split() for i, r in by_id(passages.without_repeats(frame)).items()}
    assert all(left[i] == [w for w in rows[i] if i % 2 == 0 or not w.startswith("s")] for i in range(3000))
    assert all(left[i] == rows[i] for i in range(3000, 3300))


@pytest.mark.parametrize("run", [8, 30, 90])
def test_stretches_of_few_words_equal_brute_force(spark, run):
    """A vocabulary of three words, words that a text repeats in a row, and copies with edits: anchors are tied and runs differ."""
    rng = random.Random(run)
    base = [rng.choice("abc") for _ in range(6 * run)]
    rows = {i: [rng.choice("abc") for _ in range(rng.randrange(4 * run))] for i in range(20)}
    for i in range(20, 40):
        a = rng.randrange(len(base))
        rows[i] = [w if rng.random() > 0.3 / run else "x" for w in base[a : a + rng.randrange(run, 4 * run)]]
    rows |= {40: ["a"] * 2 * run, 41: ["b", *["a"] * (run - 1), "b"], 42: ["a"] * run, 43: [], 44: ["a"] * (run - 1)}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    spans = collections.defaultdict(set)
    for i, words in rows.items():
        for j in range(len(words) - run + 1):
            spans[tuple(words[j : j + run])].add((i, j))
    want = collections.defaultdict(set)
    for places in spans.values():
        if len({i for i, _ in places}) > 1:
            for i, j in places:
                want[i, min(places)[0]] |= set(range(j, j + run))
    covered = collections.defaultdict(set)
    with lineage.Scratch(spark) as scratch:
        for r in passages.shared_stretches(frame, scratch, 8, run).collect():
            assert " ".join(rows[r.doc_id])[r.begin : r.end].split() == rows[r.doc_id][r.word : r.word + r.n_words]
            covered[r.doc_id, r.keeper_doc_id] |= set(range(r.word, r.word + r.n_words))
    assert covered == want and len(want) > 10


# The pipeline.


def test_pipeline_stages_equal_brute_force(spark, docs):
    import corpus_pipeline

    (_, rules), (_, dedup), (_, secrets), (_, mix), (_, pack) = corpus_pipeline.STAGES
    stage = lambda f, df: spark.createDataFrame(f(spark, df, DATA).toPandas().astype(object).where(lambda x: x.notna(), None), docs.schema)
    one = stage(rules, docs)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality.judged(docs).collect() if r.kept}
    two = stage(dedup, one)
    groups = brute_groups({r.doc_id: r.text for r in one.collect()}, 5)
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i, (_, root) in groups.items() if i == root)
    three = stage(secrets, two)
    before = by_id(two)
    for r in three.collect():
        assert r.text == secretscan.redact(before[r.doc_id].text) and (r.text == before[r.doc_id].text or r.n_chars == len(r.text))
    four = stage(mix, three)
    copies = {r.doc_id: r.copies for r in mixing.mixed_rows(three).collect()}
    assert collections.Counter(r.doc_id for r in four.collect()) == +collections.Counter(copies)
    rows = pack(spark, four, DATA).collect()
    check_packing(rows)
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == +collections.Counter(copies)


def test_pipeline_runs_on_odd_documents(spark, odd, tmp_path):
    import corpus_pipeline

    for name, df in (("some", odd), ("none", odd.where("false"))):
        df.withColumnRenamed("size", "extra").write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in rows} <= {1} and json.dumps([r.length for r in rows])


# SQL.


def test_queries_equal_sql(spark):
    import duckdb

    from foliospark.llm import queries

    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "clicks", "sales"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(sql).df()
        # Whole numbers with nulls come as floats from one side.
        whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
        plain = lambda f: sorted(repr(tuple(map(whole, r))) for r in f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None))
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
        assert plain(got) == plain(want), name
