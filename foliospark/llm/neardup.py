"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

1. Each text's set of word shingles is hashed to 64 bits. The set's hashes fall into ``bands * rows`` bins by their
   leading bits; a bin's least hash is its slot, and an empty bin takes the slot of the first filled bin in an
   order of bins that is its own (optimal densification). ``rows`` slots make a band's key.
2. Documents with equal sets are one class, represented by the least id; only representatives go on.
3. In each bucket (equal keys) every member is compared with one hub, the least id, so a bucket of m members makes m - 1
   pairs. A pair is a link if the similarity of the two full sets, computed anew from the texts, is high enough.
4. A star says nothing of two members x and y that share the bucket, if x isn't linked with the hub h. Let dx and dy
   be the symmetric differences of their sets with h's. They are short lists, and all that is needed: |dx + dy| less
   twice their common part is the symmetric difference of x and y. If dx and dy had nothing in common, x and y would be
   no more alike than x and h. So each x is looked up, in blocks, in an index of the differences of the hub's other
   members, and only links come out. No pair that shares a bucket is left undecided, and no rows are made for pairs.
5. Components of the links give the groups.

With 32 bands of 5 rows a pair of similarity 0.8 shares no bucket with probability 3e-6, less above it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, Scratch, cut, hinted, mixed, rolling, text_slices, unused
from .components import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
#: Bytes of differences that a block of a hub's members or queries has, on average.
BLOCK_BYTES = 8 << 20
#: Strata of a block's index; blocks of few members have one, which doesn't change what is found.
STRATA, FEW = 4, 200
#: Blocks of at most so many pairs, and of differences of at most so many hashes, are looked up many at a time, so many pairs or hashes in a pass.
FEW_PAIRS, SHORT, PASS_PAIRS, PASS_HASHES = 1024, 256, 1 << 16, 1 << 20
#: What names a block: a hub, classes of set size of its queries and members, and numbers among the blocks of each.
BLOCK_KEYS = ["a", "here", "there", "i", "k"]
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(block: Block, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer words has its whole sequence as one."""
    h = block.word_hashes()
    rolled = mixed(rolling(h, words))
    sets = []
    for i in range(block.n):
        a, b = block.first[i], block.first[i + 1]
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            sets.append(own[np.diff(own, prepend=~own[:1]) != 0])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * _FACTOR + x
            sets.append(mixed(np.array([whole])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


class Signer:
    """One-permutation signatures of sorted hash sets and the keys of their bands."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.salt = rng.integers(1, 1 << 62, bands, np.int64).astype(np.uint64)

    def slots(self, hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """(n, bins): the slots of n sets, none of which is empty; of: each hash's set. Repeated hashes make no difference."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        slots, filled = np.full(n * self.bins, np.iinfo(np.uint64).max, np.uint64), np.zeros((n, self.bins), bool)
        np.minimum.at(slots, bins + of * self.bins, hashes)
        filled.ravel()[bins + of * self.bins] = True
        slots = slots.reshape(n, self.bins)
        rows, empty = np.nonzero(~filled)
        order = self.order[empty]
        first = np.argmax(np.take_along_axis(filled[rows], order, axis=1), axis=1)
        slots[rows, empty] = slots[rows, order[np.arange(len(order)), first]]
        return slots

    def signed(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(n, bands): the keys of n sets of so many hashes each, one or more; in parts, as each empty bin looks at all bins."""
        out, ends = [np.zeros((0, self.bands), np.int64)], np.concatenate(([0], np.cumsum(sizes)))
        part = max(1, (1 << 23) // self.bins**2)
        for a in range(0, len(sizes), part):
            own = sizes[a : a + part]
            of = np.repeat(np.arange(len(own)), own)
            out.append(self.keys(self.slots(hashes[ends[a] : ends[a + len(own)]], of, len(own))))
        return np.concatenate(out)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """Of signatures (n, bins): (n, bands) keys, unlike between bands."""
        parts = slots.reshape(len(slots), self.bands, self.rows)
        key = np.broadcast_to(self.salt, parts.shape[:2])
        for k in range(self.rows):
            key = mixed(key * _FACTOR + parts[:, :, k])
        return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if it is empty), keys; repeated rows of a doc_id stay."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for part in text_slices(batches, "text"):
            sets = shingle_hashes(Block(part.column("text"), lower=True), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            flat = np.concatenate([sets[i] for i in full]) if full else np.zeros(0, np.uint64)
            keys = signer.signed(flat, np.array([len(sets[i]) for i in full], np.int64))
            at = np.zeros(len(sets) + 1, np.int32)
            at[1:] = np.cumsum([bands * bool(len(s)) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())),
                ],
                ["doc_id", "n_shingles", "digest", "keys"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, keys array<long>")


def compared(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b, n (size of b's set), linked, delta of pairs (a, b); texts: doc_id, text of at least their ends, once each.

    delta: the hashes that only one of the two full sets has. Intersection and union are whole numbers, similarity
    counts in thousandths.
    """
    least = round(similarity * 1000)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for part in text_slices(text_slices(batches, "text_b"), "text_a"):
            sets = shingle_hashes(Block(part.column("text_b"), lower=True), words)
            of, linked, deltas = part.column("a").to_pylist(), np.zeros(part.num_rows, bool), []
            # The rows with another hub than the row before have theirs hashed together.
            fresh = [i for i, x in enumerate(of) if x != (of[i - 1] if i else hub)]
            hubs = iter(shingle_hashes(Block(part.column("text_a").take(pa.array(fresh, pa.int64())), lower=True), words))
            for i, s in enumerate(sets):
                if of[i] != hub:
                    hub, hub_set = of[i], next(hubs)
                both = np.concatenate((hub_set, s))
                both.sort()
                same = both[1:] == both[:-1]
                common = int(np.count_nonzero(same))
                linked[i] = common > 0 and 1000 * common >= least * (len(both) - common)
                alone = np.ones(len(both), bool)
                alone[1:] &= ~same
                alone[:-1] &= ~same
                deltas.append(both[alone].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array([len(s) for s in sets], pa.int32()), pa.array(linked), pa.array(deltas, pa.list_(pa.int64()))],
                ["a", "b", "n", "linked", "delta"],
            )

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long, n int, linked boolean, delta array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return compared(pairs, texts, words, similarity).where("linked").select("a", "b")


def missed(stars: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of one hub's star that the star itself doesn't show, as many as join all whom any join.

    stars: what compared() returns. Queries are the members that aren't linked with their hub. Members
    and queries are dealt by classes of set size, of which only neighbouring ones can be similar enough, and within these
    by a hash to blocks of bounded bytes; each block of queries meets each block of members.
    """
    # A member has so many bytes; the set sizes of a link are at most 1 / similarity apart (a little more, for rounded logarithms).
    stars = stars.withColumn("bytes", F.size("delta").cast("long") * 8 + 64).withColumn("level", F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity * 0.9999)).cast("int"))
    asked = F.col("bytes") * F.when(F.col("linked"), 0).otherwise(1)
    sizes = stars.groupBy("a", "level").agg(F.sum("bytes").alias("all"), F.sum(asked).alias("asked"), F.count("*").alias("members"))
    sizes = sizes.select("a", "level", "members", *(F.ceil(F.col(c) / BLOCK_BYTES).cast("int").alias(c) for c in ("all", "asked")))
    # Classes of queries with the classes of members that they meet.
    near = F.explode(F.array(*(F.col("level") + k for k in (-1, 0, 1)))).alias("there")
    meets = sizes.where("asked > 0").select("a", F.col("level").alias("here"), near, F.col("asked").alias("parts"))
    meets = meets.join(sizes.select("a", F.col("level").alias("there"), F.col("all").alias("blocks"), "members"), ["a", "there"])
    # A member that is the only one of its class meets none but itself there.
    meets = meets.where("here <> there or members > 1").drop("members")
    # What the star shows: its linked members are of one component.
    rows = stars.withColumn("component", F.when(F.col("linked"), F.col("a")).otherwise(F.col("b")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("b"), F.col(c)).cast("int")
    kept = ["a", "here", "there", "b", "n", "component", "delta"]
    members = rows.withColumnRenamed("level", "there").join(meets, ["a", "there"])
    members = members.select(*kept, every("parts").alias("i"), own("blocks").alias("k"), F.lit(0).alias("role"))
    queries = rows.where("not linked").withColumnRenamed("level", "here").join(meets, ["a", "here"])
    queries = queries.select(*kept, own("parts").alias("i"), every("blocks").alias("k"), F.lit(1).alias("role"))
    dealt = members.union(queries).repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
    return dealt.mapInArrow(lambda batches: _links_of_blocks(batches, similarity), "a long, b long")


def _links_of_blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """a, b: links of rows that are sorted by their blocks' keys."""
    # A set's least overlap with a partner's difference: what the union of both can leave over.
    spare = (1 - similarity) / similarity
    for rows, starts in _groups(batches, BLOCK_KEYS):
        role, size = rows.column("role").to_numpy(), pc.list_value_length(rows.column("delta")).to_numpy()
        asked = np.add.reduceat(role, starts, dtype=np.int64)
        ends = np.append(starts[1:], rows.num_rows)
        few = (asked * (ends - starts - asked) <= FEW_PAIRS) & (np.maximum.reduceat(size, starts) <= SHORT)
        for a, b in zip(starts[~few].tolist(), ends[~few].tolist()):
            yield _pairs(_block_links(rows.slice(a, b - a), similarity, spare))
        block = np.repeat(np.arange(len(starts)), ends - starts)
        if few.any():
            yield _few_links(rows.filter(pa.array(few[block])), block[few[block]], similarity)


def _block_links(group: pa.Table, similarity: float, spare: float) -> list[tuple[int, int]]:
    """For each query (role 1) of a block and each other component of its members (role 0) that it is linked with: one link.

    Two of a hub's members x and y whose differences from it are dx and dy are apart by |dx| + |dy| - 2 |dx & dy|, which a link bounds by
    (|x| + |y|) (1 - s) / (1 + s), and for x alone by spare * |x|. So dx and dy have at least t hashes in common, the greater
    of half of what |dx| + |dy| exceeds the first by and |dx| - spare * |x|. In an order of all hashes, rarest first, the first |dx| - t + 1
    of dx and as many of dy thus have one in common: only these are indexed and looked up, in strata of members with differences of
    like size, as t is greater the narrower these are. Components that got linked count as one from then on; hashes of which
    all members are of the query's component are passed over.
    """
    least = round(similarity * 1000)
    delta = group.column("delta").combine_chunks()
    at, values = delta.offsets.to_numpy(), delta.flatten().to_numpy()
    at = at - at[0]
    b, n, component, role = (group.column(c).to_numpy() for c in ("b", "n", "component", "role"))
    if not (role == 1).any() or not (role == 0).any():
        return []
    size = np.diff(at)
    names, label = np.unique(component, return_inverse=True)
    merged = np.arange(len(names))
    # Differences as numbers of hashes by falling rarity (counted among members), each in that order.
    of = np.repeat(np.arange(len(size)), size)
    known, number = np.unique(values, return_inverse=True)
    often = np.bincount(number[role[of] == 0], minlength=len(known))
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(known))
    number = rank[number]
    number = number[np.lexsort((number, of))]
    # Half of what differences exceed their sets' share of the bound by, and the least overlap by a set's own bound.
    excess = (size - (1 - similarity) / (1 + similarity) * n) / 2
    alone = np.maximum(1, np.ceil(size - spare * n - 1e-6))
    asked, there = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    there = there[np.argsort(excess[there], kind="stable")]
    strata = [_Stratum(part, number, at, of, size, excess, alone, float(excess[asked].min()), len(known)) for part in np.array_split(there, STRATA if len(there) > FEW else 1)]
    found: list[tuple[int, int]] = []
    for q in asked.tolist():
        mine = number[at[q] : at[q + 1]]
        for stratum in strata:
            home = merged[label[q]]
            t = max(alone[q], math.ceil(excess[q] + stratum.least - 1e-6))
            probe, owners, ends = stratum.look_up(mine[: max(0, int(size[q] - t) + 1)], merged, home)
            if not len(probe):
                continue
            near = np.unique(owners[merged[label[owners]] != home])
            total, apart = int(n[q]) + n[near].astype(np.int64), np.abs(size[q] - size[near])
            near = near[1000 * (total - apart) >= least * (total + apart)]
            step = 64
            while len(near):
                some, near = near[:step], near[step:]
                step *= 2
                lengths = size[some]
                inner = np.cumsum(lengths) - lengths
                theirs = number[np.repeat(at[some] - inner, lengths) + np.arange(int(lengths.sum()))]
                spot = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                common = np.add.reduceat((mine[spot] == theirs).astype(np.int64), inner)
                apart, total = size[q] + lengths - 2 * common, int(n[q]) + n[some].astype(np.int64)
                linked = some[1000 * (total - apart) >= least * (total + apart)]
                if len(linked):
                    theirs, one = np.unique(merged[label[linked]], return_index=True)
                    found += [(int(b[q]), int(b[linked[k]])) for k in one]
                    merged[np.isin(merged, theirs)] = home
                    near = near[merged[label[near]] != home]
            alike = np.logical_and.reduceat(merged[label[owners]] == home, ends)
            stratum.uniform[probe[alike]] = label[q]
    return found


class _Stratum:
    """An index of the first hashes of some members' differences."""

    def __init__(self, members: np.ndarray, number: np.ndarray, at: np.ndarray, of: np.ndarray, size: np.ndarray, excess: np.ndarray, alone: np.ndarray, asked: float, known: int):
        self.least = float(excess[members].min())
        prefix = np.zeros(len(size))
        prefix[members] = size[members] - np.maximum(alone[members], np.ceil(excess[members] + asked - 1e-6)) + 1
        posted = np.flatnonzero(np.arange(len(number)) - at[of] < prefix[of])
        order = posted[np.argsort(number[posted], kind="stable")]
        self.owner = of[order]
        self.begins = np.searchsorted(number[order], np.arange(known + 1))
        #: Of hashes: a label, if all their owners were of its component when last seen; components only grow.
        self.uniform = np.full(known, -1, np.int64)

    def look_up(self, probe: np.ndarray, merged: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of probe that may lead to other components than home, the owners of each, and where each one's begin."""
        sure = self.uniform[probe]
        probe = probe[(sure < 0) | (merged[sure] != home)]
        count = self.begins[probe + 1] - self.begins[probe]
        probe, count = probe[count > 0], count[count > 0]
        starts = np.cumsum(count) - count
        return probe, self.owner[np.repeat(self.begins[probe] - starts, count) + np.arange(int(count.sum()))], starts


def _passes(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most so much size together, or of one."""
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, "right")))
        yield low, high
        low = high


def _few_links(rows: pa.Table, of: np.ndarray, similarity: float) -> pa.RecordBatch:
    """a, b: links of queries (role 1) with members (role 0) of other components in the same block; of: each row's block, ascending.

    Every such pair is decided. Differences are as far apart as their sets are. Bits of their hashes, and their sizes, bound that from below, so few are compared.
    """
    least = round(similarity * 1000)
    delta = rows.column("delta").combine_chunks()
    at, values = delta.offsets.to_numpy(), delta.flatten().to_numpy().view(np.uint64)
    at = at - at[0]
    b, n, component, role = (rows.column(c).to_numpy() for c in ("b", "n", "component", "role"))
    size = np.diff(at)
    bits = np.zeros((len(size), 256), bool)
    bits[np.repeat(np.arange(len(size)), size), values >> np.uint64(56)] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    asked, there = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    begin, end = (np.searchsorted(of[there], of[asked], side) for side in ("left", "right"))
    count, found = end - begin, []
    for low, high in _passes(count, PASS_PAIRS):
        some = count[low:high]
        x = np.repeat(asked[low:high], some)
        y = there[np.arange(len(x)) + np.repeat(begin[low:high] - (np.cumsum(some) - some), some)]
        near = component[x] != component[y]
        x, y = x[near], y[near]
        total = n[x].astype(np.int64) + n[y]
        apart = np.maximum(np.abs(size[x] - size[y]), np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64))
        near = 1000 * (total - apart) >= least * (total + apart)
        near_x, near_y, total = x[near], y[near], total[near]
        for i, j in _passes(size[near_x] + size[near_y], PASS_HASHES):
            x, y = near_x[i:j], near_y[i:j]
            # The pairs' differences side by side: what a pair has twice is common to both.
            sizes = np.stack((size[x], size[y]), axis=1).ravel()
            inner = np.cumsum(sizes) - sizes
            flat = values[np.repeat(np.stack((at[x], at[y]), axis=1).ravel() - inner, sizes) + np.arange(int(sizes.sum()))]
            pair = np.repeat(np.arange(len(x)), size[x] + size[y])
            flat = flat[np.lexsort((flat, pair))]
            common = np.bincount(pair[1:][(flat[1:] == flat[:-1]) & (pair[1:] == pair[:-1])], minlength=len(x))
            apart = size[x] + size[y] - 2 * common
            linked = 1000 * (total[i:j] - apart) >= least * (total[i:j] + apart)
            found.append(np.stack((b[x[linked]], b[y[linked]])))
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows, and where the runs of them with equal keys (whole numbers) start; runs are whole even where they span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[0].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(held), np.zeros(1, np.int64)
            held = []
        if len(starts):
            # All but the last run, which may go on.
            first = sum(b.num_rows for b in held)
            yield pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]))]), np.concatenate(([0], first + starts[:-1]))
            held = []
        held.append(batch.slice(int(starts[-1]) if len(starts) else 0))
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least linked doc_id, its own included), kept, for each row of docs (doc_id, text).

    Words are runs of non-spaces after lower-casing A-Z. Null, empty and blank texts have no shingles and are
    linked with nothing. Rows that repeat a doc_id are one document, whose text is the least of theirs; each of them
    appears. Rows with a null doc_id have a null component and are kept. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = not rows_.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    full = rows_.groupBy("doc_id").agg(F.min("text").alias("text")).where("doc_id is not null") if repeats else rows_
    with Scratch(spark) as scratch:
        signed = scratch.keep(signatures(full, words, bands, rows))
        named = signed.where("doc_id is not null and digest is not null")
        classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
        of_class = scratch.keep(named.select("digest", "doc_id").join(classes, "digest").select("doc_id", "rep"))
        nodes = classes.select(F.col("rep").alias("node"))

        # The representatives' keys, in buckets of two members or more.
        members = named.join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
        members = members.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
        stars = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
        pairs = scratch.keep(members.join(stars, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
        ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        # The hints leave few texts to shuffle; the join is the same at every size.
        texts = scratch.keep(hinted(full, "doc_id", ends).join(ends.hint("merge"), "doc_id"))
        found = scratch.keep(compared(pairs, texts, words, similarity))
        of = components(found.where("linked").select("a", "b").union(missed(found, similarity)), nodes)

        group = of_class.join(of, F.col("rep") == F.col("node")).select(F.col("doc_id").alias("id"), "component")
        found = signed.select("doc_id", "n_shingles")
        if repeats:
            found = rows_.select("doc_id").join(found, "doc_id", "left").fillna(0, "n_shingles")
        component = F.coalesce("component", "doc_id")
        found = found.join(group, F.col("doc_id") == F.col("id"), "left").select(
            "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
        )
        return cut(found)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all their columns whatever their names, without near duplicates: of each group the least doc_id stays, once.

    Of rows that repeat an id that with the least text stays, any of equal ones. Rows with a null doc_id all stay, as do texts without
    words. An empty table gives an empty result.
    """
    kept, rows = unused(docs.columns, "kept", "rows")
    found = near_duplicates(docs, **options)
    stay = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(kept)).agg(F.count("*").alias(rows))
    joined = docs.join(stay, docs["doc_id"].cast("long") == F.col(kept))
    once = joined.where(F.col(rows) == 1).select(docs["*"])
    if not stay.where(F.col(rows) > 1).isEmpty():
        again = joined.where(F.col(rows) > 1).groupBy(kept).agg(F.min_by(F.struct(docs["*"]), F.coalesce("text", F.lit(""))).alias(rows))
        once = once.unionByName(again.select(f"{rows}.*"))
    return once.unionByName(docs.where("doc_id is null"))
