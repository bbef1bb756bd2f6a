"""Passages that documents share, by paragraph MinHash banding.

1. Texts are cut into paragraphs at line ends and at sentence ends, since a passage taken into another text seldom keeps
   its lines. Neighbouring pieces of fewer than five words are joined until they have five; the last ones that have fewer
   together belong to the joined ones before, and without these they are no paragraph: point 4 covers their words.
2. Paragraphs with equal words are one class. Classes of LONG words or more (8 and 9 are the fewest that can be alike but
   unequal) also get the keys of MinHash bands tuned for recall; in each bucket of a key, members are paired with its least class.
3. Pairs whose sets of five-word shingles have an exact Jaccard similarity of 0.8 or more are linked, those of two members
   of a bucket that are both unlike its least class by their differences to it, as in neardup; components of
   links and equality give groups of paragraphs, and those of several documents are repeats.
4. Whatever its lines and sentences, every stretch of RUN words or more that two texts share word for word is found too, to its exact edges:
   a span of RUN words has as its anchor the shorter span in it (half of RUN words and one more) with the least hash (winnowing), and neighbouring
   spans with one anchor are a run. Runs with equal words count once; only where runs differ around an anchor that documents share are spans compared one by one.
5. A run of neighbouring repeats in a text, gaps of fewer than five words included, is a passage if it has RUN words or
   more. What the least document of a group has stays, the others are removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import release
from .common import LEADS, Block, Scratch, buckets_for, cut, hint_bits, hinted, may_be_among, mixed, rolling, shared_values, text_slices, unused
from .components import components
from .neardup import Signer, compared, missed

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of slots: a pair of similarity 0.8 shares no bucket with probability 0.002.
BANDS, ROWS = 6, 2
LONG, RUN = 8, 30
#: Classes that a task remembers at a time, about.
REMEMBERED = 500_000
_FACTOR = np.uint64(0x8CB92BA72F3D8DD7)


def paragraphs(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, unit, begin, end (code points), word, n_words, class, check, keys, text of each text's paragraphs.

    unit numbers a text's paragraphs of five words or more; word is the number of the first word. Equal words have equal class and
    check (95 bits together). keys has eight bytes for each band. Keys are empty and text is null for paragraphs of fewer than LONG words, and for those whose class the
    task has met before (as far as it remembers): they belong to the class, and one of it that has them is enough.
    """
    names = ["doc_id", "unit", "begin", "end", "word", "n_words", "class", "check", "keys", "text"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, met = Signer(bands, rows), set()
        for part in text_slices(batches, "text"):
            block = Block(part.column("text"), lower=True)
            yield pa.RecordBatch.from_arrays(_units(part.column("doc_id"), block, signer, met), names)
            if len(met) > REMEMBERED:
                met.clear()

    sql = "doc_id long, unit int, begin int, end int, word int, n_words int, class long, check int, keys binary, text string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(cut_up, sql)


def _int32(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int32))


def _places(block: Block, of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of their own texts at which byte spans begin and end; of: their texts."""
    lead = np.concatenate((np.zeros(1, np.int32), np.cumsum(LEADS[block.buf], dtype=np.int32)))
    base = lead[block.offs[of]]
    return lead[starts] - base, lead[ends] - base


def _units(doc_ids: pa.Array, block: Block, signer: Signer, met: set[int]) -> list[pa.Array]:
    n = len(block.starts)
    # A paragraph ends after a word that ends a sentence, or with which its line or text ends.
    last = block.buf[block.ends - 1] if n else np.zeros(0, np.uint8)
    following = np.append(block.starts[1:], len(block.buf)) if n else block.starts
    lines = np.cumsum(block.buf == 10, dtype=np.int32)
    stops = np.isin(last, np.frombuffer(b".!?", np.uint8)) | (lines[following - 1] > lines[block.ends - 1])
    begins = np.flatnonzero(np.concatenate(([True], stops[:-1]))) if n else np.zeros(0, np.int64)
    begins, sizes = _joined(begins, np.diff(np.append(begins, n)), np.isin(begins, block.first))
    hashes = block.word_hashes()
    of = np.searchsorted(block.first, begins, "right") - 1
    # Texts without words share a first word with their successor: take the last text that starts there.
    unit = np.arange(len(begins)) - np.searchsorted(of, of)
    classes, check = np.zeros(0, np.int64), np.zeros(0, np.int32)
    # The class: a sum over positions inside the paragraph, so it is the words in their order; the check: another such sum.
    if len(begins):
        powers = np.multiply.accumulate(np.full(int(sizes.max()), _FACTOR))
        starts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        words = hashes[np.repeat(begins, sizes) + place]
        classes = mixed(np.add.reduceat(words * powers[place], starts) + sizes.astype(np.uint64)).view(np.int64)
        check = (mixed(np.add.reduceat(mixed(words ^ _FACTOR) * powers[place], starts)) >> np.uint64(33)).astype(np.int32)
    # Of each class of LONG words or more that is new, the first paragraph has keys and text.
    long_ = np.flatnonzero(sizes >= LONG)
    known, first = np.unique(classes[long_], return_index=True)
    new = [c not in met for c in known.tolist()]
    met.update(known.tolist())
    told = np.sort(long_[first[new]]) if len(long_) else long_
    spans = sizes[told] - SHINGLE + 1
    place = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
    shingles = mixed(rolling(hashes, SHINGLE))[np.repeat(begins[told], spans) + place] if len(told) else hashes[:0]
    flat = signer.signed(shingles, spans).ravel()
    counts = np.zeros(len(begins) + 1, np.int32)
    counts[told + 1] = 8 * signer.bands
    begin, end = block.starts[begins], block.ends[begins + sizes - 1]
    # Texts of paragraphs: every second run of the bytes between all begins and ends.
    edges = np.stack((begin, end), axis=1).ravel()
    runs = pa.LargeStringArray.from_buffers(max(0, len(edges) - 1), pa.py_buffer(np.ascontiguousarray(edges)), pa.py_buffer(np.ascontiguousarray(block.buf)))
    wanted = np.zeros(len(begins), bool)
    wanted[told] = True
    texts = runs.take(pa.array(2 * np.arange(len(begins)), mask=~wanted)).cast(pa.string())
    first_point, last_point = _places(block, of, begin, end)
    return [
        doc_ids.take(pa.array(of)), _int32(unit), _int32(first_point), _int32(last_point), _int32(begins - block.first[of]), _int32(sizes),
        pa.array(classes), pa.array(check), pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.cumsum(counts, dtype=np.int32)), pa.py_buffer(flat)]), texts,
    ]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least of the width values from each place on is, the first of equal ones."""
    at, best, done = np.arange(len(x)), x, 1
    while done < width:
        step = min(done, width - done)
        n = max(0, len(x) - step)
        lower = best[step:] < best[:n]
        at, best = (np.concatenate((np.where(lower, y[step:], y[:n]), y[n:])) for y in (at, best))
        done += step
    return at


def _runs(part: pa.RecordBatch, run: int, size: int) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block of texts and its runs of neighbouring spans of run words that have one anchor.

    Of each run: the hash of its anchor, the words of which are in all its spans, its first span's first word, and how many spans it has; last, hashes
    of the spans from each word on, unmixed.
    """
    block = Block(part.column("text"), lower=True)
    words = block.word_hashes()
    spans = rolling(words, run)
    starts = np.flatnonzero(np.arange(len(spans)) + run <= np.repeat(block.first[1:], block.n_words)[: len(spans)])
    grams = mixed(rolling(words, size))
    at = _least(grams, run - size + 1)[starts]
    head = np.flatnonzero(np.diff(at, prepend=-1))
    return block, grams[at[head]], starts[head], np.diff(head, append=len(starts)), spans


def _named(first: np.ndarray, n: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Hashes of all words of runs: their first and their last span cover them."""
    return mixed(mixed(spans[first]) * _FACTOR + spans[first + n - 1] + n.astype(np.uint64))


def _occurrences(docs: DataFrame, run: int, size: int, bits: np.ndarray) -> DataFrame:
    """doc_id, gram, run, word, n of the runs whose anchor several documents may have."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            block, grams, first, n, spans = _runs(part, run, size)
            kept = may_be_among(grams, bits)
            grams, first, n = grams[kept], first[kept], n[kept]
            of = np.searchsorted(block.first, first, "right") - 1
            columns = [part.column("doc_id").take(pa.array(of)), *(pa.array(x.view(np.int64)) for x in (grams, _named(first, n, spans))), _int32(first - block.first[of]), _int32(n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "gram", "run", "word", "n"])

    return docs.mapInArrow(choose, "doc_id long, gram long, run long, word int, n int")


def _spans(docs: DataFrame, run: int, size: int, bits: np.ndarray) -> DataFrame:
    """gram, run, spans: hashes of the spans, in order, of the runs whose anchor may be among the bits; each run once in a slice of texts."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            _, grams, first, n, spans = _runs(part, run, size)
            kept = np.flatnonzero(may_be_among(grams, bits))
            names = _named(first[kept], n[kept], spans)
            names, once = np.unique(names, return_index=True)
            kept = kept[once]
            grams, first, n = grams[kept], first[kept], n[kept]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            grams, names, hashes = (pa.array(x.view(np.int64)) for x in (grams, names, mixed(spans[np.repeat(first, n) + place])))
            lists = pa.ListArray.from_arrays(_int32(np.append(0, np.cumsum(n))), hashes)
            yield pa.RecordBatch.from_arrays([grams, names, lists], ["gram", "run", "spans"])

    return docs.mapInArrow(choose, "gram long, run long, spans array<long>")


def _placed(docs: DataFrame, repeats: DataFrame, run: int) -> DataFrame:
    """doc_id, word, n_words, begin, end (code points), component, keeper_doc_id of stretches.

    repeats: doc_id, word, places, gram, keeper_doc_id; the bits of places tell which spans from word on repeat. What overlaps or touches and has the same keeper is one stretch.
    """
    item = F.struct("word", "places", "gram", "keeper_doc_id")
    lists = repeats.groupBy("doc_id").agg(F.collect_list(item).alias("repeats"))
    rows = hinted(docs, "doc_id", repeats.select("doc_id").distinct()).join(lists, "doc_id").select("text", "doc_id", "repeats")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            block, lists = Block(part.column("text")), part.column("repeats")
            of, flat = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
            word, places, gram, keeper = (flat.field(c).to_numpy() for c in ("word", "places", "gram", "keeper_doc_id"))
            row, bit = np.nonzero(np.unpackbits(places.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            of, word, gram, keeper = of[row], word[row] + bit, gram[row], keeper[row]
            # Where rows repeat an id, each row has the stretches of all.
            own = np.flatnonzero(word + run <= block.n_words[of])
            order = own[np.lexsort((word[own], keeper[own], of[own]))]
            of, word, gram, keeper = of[order], word[order], gram[order], keeper[order]
            head = np.ones(len(of), bool)
            head[1:] = (np.diff(of) != 0) | (np.diff(keeper) != 0) | (np.diff(word) > run)
            head = np.flatnonzero(head)
            of, keeper, last = of[head], keeper[head], np.append(head[1:], len(word))[: len(head)] - 1
            least = np.minimum.reduceat(gram, head) if len(head) else gram
            begin_, end_ = word[head], word[last] + run
            at = block.first[of]
            begin, end = _places(block, of, block.starts[at + begin_], block.ends[at + end_ - 1])
            columns = [part.column("doc_id").take(pa.array(of)), *map(_int32, (begin_, end_ - begin_, begin, end)), pa.array(least), pa.array(keeper)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "word", "n_words", "begin", "end", "component", "keeper_doc_id"])

    return rows.mapInArrow(place, "doc_id long, word int, n_words int, begin int, end int, component long, keeper_doc_id long").distinct()


def shared_stretches(docs: DataFrame, scratch: Scratch, buckets: int, run: int = RUN) -> DataFrame:
    """doc_id, word, n_words, begin, end, component, keeper_doc_id of words that are equal in several documents.

    A word is in a stretch if it is in a span of run words that another document has too, whichever that is: so stretches have exact edges, and one of run words
    or more that any two documents share is found whole. The keeper is the least document that has the span; a row joins the spans that overlap or touch and have the
    same keeper, and its component is the least of their anchors' hashes. Spans are equal if 128 bits of hashes are. Fewer than run words in common are no
    stretch, even where a text has such of several documents side by side.
    """
    # A run of spans has as many places as a long has bits, at most.
    size = max(run // 2 + 1, run - 61)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in text_slices(batches, "text"):
            block, grams, first, _, _ = _runs(part, run, size)
            yield grams, part.column("doc_id").to_numpy()[np.searchsorted(block.first, first, "right") - 1]

    bits = hint_bits(shared_values(named, pairs, buckets))
    found = scratch.keep(_occurrences(named, run, size, bits))
    release(docs.sparkSession)
    # Equal runs are one row from here on; numbers only, so that hot ones are reduced before they are shuffled.
    runs = scratch.keep(found.groupBy("gram", "run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("n").alias("n")))
    anchors = runs.groupBy("gram").agg(F.min("low").alias("least"), F.max("high").alias("most"), (F.min("run") < F.max("run")).alias("open"))
    anchors = scratch.keep(anchors.where("least < most").select("gram", "open"))
    release(docs.sparkSession)
    # A run that is the only one of its anchor repeats as a whole.
    whole = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - F.col("n")).alias("places")
    closed = runs.join(anchors.where("not open"), "gram").select("gram", "run", F.col("low").alias("keeper_doc_id"), whole)
    # Of runs that differ around one anchor, the spans repeat that several documents have; the least document of a run tells its spans.
    open_ = scratch.keep(runs.join(anchors.where("open"), "gram").select("gram", "run", "low", "high"))
    tellers = hinted(named, "doc_id", open_.select("low").distinct())
    told = _spans(tellers, run, size, hint_bits(anchors.where("open").select("gram"))).distinct()
    # Runs are moved and made distinct as one row each, and only then taken apart.
    told = scratch.keep(told.join(open_, ["gram", "run"])).select("gram", "run", "low", "high", F.posexplode("spans").alias("place", "span"))
    spans = told.groupBy("gram", "span").agg(F.min("low").alias("keeper_doc_id"), F.max("high").alias("top")).where("keeper_doc_id < top").drop("top")
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    parts = told.join(spans, ["gram", "span"]).groupBy("gram", "run", "keeper_doc_id").agg(F.bit_or(place).alias("places"))
    repeated = scratch.keep(closed.unionByName(parts))
    release(docs.sparkSession)
    repeats = scratch.keep(found.join(repeated, ["gram", "run"]).select("doc_id", "word", "places", "gram", "keeper_doc_id"))
    scratch.drop(found)
    release(docs.sparkSession)
    return _placed(named, repeats, run)


def _joined(begins: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of paragraphs of SHINGLE words or more, from those of all pieces; heads: the first pieces of texts."""
    begins, sizes, small = begins.copy(), sizes.copy(), sizes < SHINGLE
    short = np.flatnonzero(small)
    made = open_ = -1  # the paragraph joined last in this run of short pieces, and the one that still grows
    for i, before in zip(short.tolist(), [-2, *short[:-1].tolist()]):
        if i != before + 1 or heads[i]:
            made = open_ = -1
        if open_ < 0:
            open_ = i
        else:
            sizes[open_] += sizes[i]
            sizes[i] = 0
        if sizes[open_] >= SHINGLE:
            made, open_ = open_, -1
        elif made >= 0 and (i + 1 == len(small) or not small[i + 1] or heads[i + 1]):
            sizes[made] += sizes[open_]
            sizes[open_] = 0
    big = sizes >= SHINGLE
    return begins[big], sizes[big]


def repeated_passages(docs: DataFrame, run: int = RUN, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, unit, begin, end, n_words, passage_words, component_id, keeper_doc_id, removed: one row for each
    paragraph of a passage that several documents share, and for each stretch of equal words in it (unit is null there).

    Rows of one passage can overlap. begin and end are code points of the text, end exclusive; passage_words counts the words of the run it is in.
    A-Z are lower-cased and white space is ignored in comparisons. Null, empty and blank texts have no paragraphs;
    rows with a null doc_id can't be named and are left out; rows that repeat a doc_id are one document, which
    shares nothing with itself. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        buckets = buckets_for(docs)
        stretches = scratch.keep(shared_stretches(docs, scratch, buckets, run).withColumn("unit", F.lit(None).cast("int")))
        release(spark)
        units = scratch.keep(paragraphs(docs, bands, rows))
        of = scratch.keep(_linked(units, scratch, buckets, similarity))
        release(spark)
        labels = scratch.keep(_groups(units, of, scratch))
        plain = hinted(units.select("doc_id", "unit", "begin", "end", "word", "n_words", "class", "check"), "class", labels.select("class"))
        repeats = plain.join(labels, ["class", "check"]).drop("class", "check").unionByName(stretches)
        order = Window.partitionBy("doc_id").orderBy("word", "n_words")
        reached = F.max(F.col("word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        repeats = repeats.withColumn("new", F.coalesce(F.col("word") - reached >= SHINGLE, F.lit(True)).cast("int"))
        runs = repeats.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        whole = Window.partitionBy("doc_id", "run")
        words = F.max(F.col("word") + F.col("n_words")).over(whole) - F.min("word").over(whole)
        found = runs.withColumn("passage_words", words).where(F.col("passage_words") >= run)
        return cut(
            found.select(
                "doc_id", "unit", "begin", "end", "n_words", "passage_words", F.col("component").alias("component_id"), "keeper_doc_id",
                (F.col("doc_id") != F.col("keeper_doc_id")).alias("removed"),
            )
        )


def _linked(units: DataFrame, scratch: Scratch, buckets: int, similarity: float) -> DataFrame:
    """class, check, component of the classes that share a bucket with another, of what paragraphs() returns."""
    # Those with a text: keys tell it without reading the texts.
    signed = units.where("octet_length(keys) > 0").select("keys", "class")

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = batch.column("keys")
        _, where, data = keys.buffers()
        at = np.frombuffer(where, np.int32)[keys.offset : keys.offset + len(keys) + 1]
        flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint64) if data is not None else np.zeros(0, np.uint64)
        return flat, np.repeat(batch.column("class").to_numpy(), np.diff(at) // 8)

    bits = hint_bits(shared_values(signed, lambda batches: map(keyed, batches), buckets))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, class_ in map(keyed, batches):
            kept = may_be_among(key, bits)
            yield pa.RecordBatch.from_arrays([pa.array(key[kept].view(np.int64)), pa.array(class_[kept])], ["key", "class"])

    members = scratch.keep(signed.mapInArrow(choose, "key long, class long"))
    release(units.sparkSession)
    stars = members.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("high")).where("hub <> high").select("key", "hub")
    met = members.join(stars, "key").where("class <> hub")
    pairs = scratch.keep(met.select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    texts = units.where("text is not null").select("class", "check", "text")
    # An inner join, ends being distinct: a semi join would be moved below the hints.
    texts = hinted(texts, "class", ends).join(ends, "class")
    texts = scratch.keep(texts.groupBy(F.col("class").alias("doc_id")).agg(F.min(F.struct("check", "text")).alias("x")).select("doc_id", "x.check", "x.text"))
    met = scratch.keep(compared(pairs, texts, SHINGLE, similarity))
    links = met.where("linked").select("a", "b").union(missed(met, similarity))
    of = components(links, texts.select(F.col("doc_id").alias("node")))
    return of.select(F.col("node").alias("class"), "component").join(texts.select(F.col("doc_id").alias("class"), "check"), "class")


def _groups(units: DataFrame, of: DataFrame, scratch: Scratch) -> DataFrame:
    """class, check, component, keeper_doc_id of the classes that several documents have, by themselves or with those linked to them."""
    classes = units.groupBy("class", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # What is read more than once is kept, without the many classes of one document; these are not sorted to find their component.
    labeled = classes.join(of.hint("shuffle_hash"), ["class", "check"], "left").where("component is not null or low < high")
    labeled = scratch.keep(labeled)
    alone = labeled.where("component is null").select("class", "check", F.col("class").alias("component"), F.col("low").alias("keeper_doc_id"))
    linked = labeled.where("component is not null")
    groups = linked.groupBy("component").agg(F.min("low").alias("keeper_doc_id"), F.max("high").alias("top")).where("keeper_doc_id < top")
    return alone.union(linked.join(groups, "component").select("class", "check", "component", "keeper_doc_id"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all their columns whatever their names, with the removals of repeated_passages() cut out of their texts.

    Null and empty texts stay as they are, as do rows with a null doc_id; of rows that repeat an id, each loses what is removed from the id's
    text. An empty table gives an empty result.
    """
    doc, spans = unused(docs.columns, "doc", "spans")
    found = repeated_passages(docs, **options).where("removed")
    lists = found.groupBy(F.col("doc_id").alias(doc)).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias(spans))
    joined = docs.join(lists, F.col("doc_id").cast("long") == F.col(doc), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def pieces(acc: Column, span: Column) -> Column:
        before = F.col("text").substr(acc["at"] + 1, F.greatest(span["begin"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.array_append(acc["out"], before).alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.col("text").substr(acc["at"] + 1, F.length("text")))

    cut_ = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.aggregate(spans, start, pieces, rest))
    return joined.withColumn("text", cut_).select(*(F.col(f"`{c}`") for c in docs.columns))
