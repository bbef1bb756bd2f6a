"""Removal of repeated byte strings by longest previous factors over suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or before in the same document. Equal
strings must meet in one task for that, so each string of LENGTH bytes has an anchor that its content alone determines: of all its substrings of a third
of LENGTH bytes the leftmost with the least hash. Neighbouring strings mostly have the same anchor; such a run of starts is what moves.

1. Runs are told by hashes of their anchor and of all bytes they cover. Of runs that are equal, all but the first are repeats as a whole.
   Each task settles what it has met itself, so that a passage which most documents have leaves a task once. A task that meets very many
   different runs around one anchor deals them out by their content and tells the anchor's bucket so.
2. Runs alone with their anchor, once equal ones are gone, repeat nothing. The others, the edges of shared stretches, are open: their bytes are read
   again and dealt by anchor. In a bucket, the suffixes that begin at anchors are sorted (by doubled words of eight bytes); the suffixes one byte,
   two bytes and more before an anchor follow from these by one stable sort by their first byte each, as in induced sorting.
3. Of each such suffix the longest previous factor reaches LENGTH bytes if, going back or forth in suffix order while neighbours have LENGTH bytes in
   common, a position is met that is smaller: that is, if it isn't the least position of its stretch of the suffix order.
4. Anchors that have more open runs than fit a bucket are settled string by string instead, in step 1's way: a run is then one string.

Spans of removed bytes are joined with the texts by id and a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import release
from .common import _BYTE, Scratch, buckets_for, cut, mixed, rolling, text_slices

LENGTH = 100
#: Starts that are looked at in one pass; bits of a place in it.
_PASS, _PLACE_BITS = 1 << 20, 21
#: Runs that a task gathers before it settles them; different ones around one anchor, of these, that are dealt out by content.
GATHERED, CROWDED = 1 << 19, 1024
#: Open runs of one anchor that its bucket takes; bytes of open runs in a bucket; buckets of runs for each of buckets_for().
MOST_OPEN, OPEN_BYTES, FINER = 1 << 16, 4 << 20, 3
_ODD = np.uint64(0xD1B54A32D192ED03)
#: What a run is, beside its document: hashes of anchor and bytes, first start, anchor's distance from it, further starts.
_RUN = {"anchor": np.uint64, "content": np.uint64, "doc_id": np.int64, "mark": np.int32, "first": np.int32, "ahead": np.int32, "more": np.int32}
#: flags: 1: the anchor has other runs elsewhere; 2: its runs are settled string by string; 4: no run, but the news of these.
_OPEN, _CROWDED, _NEWS = 1, 2, 4
_FOUND = "doc_id long, mark int, begin int, end int, ahead int, anchor long, crowded boolean"

Runs = dict[str, np.ndarray]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Mixed once more: anchors are least hashes, so nearly all are small."""
    return ((mixed(hashes ^ _ODD) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs_of(buf: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """anchor, content, the text's number, first, ahead, more of the runs of starts of ``length`` bytes in texts (offs: where each begins, and the end)."""
    gram = max(1, length // 3)
    window = length + 1 - gram
    for low in range(0, max(0, len(buf) - length + 1), _PASS):
        part = _BYTE[buf[low : low + _PASS + length - 1]]
        hashes = mixed(rolling(part, gram))
        key = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        done = 1
        while done < window:
            step = min(done, window - done)
            key = np.minimum(key[:-step], key[step:])
            done += step
        # Starts whose string lies in one text.
        starts = np.arange(len(key))
        text = np.searchsorted(offs, starts + low, "right") - 1
        starts = starts[starts + low + length <= offs[text + 1]]
        if not len(starts):
            continue
        text = text[starts]
        anchor = (key[starts] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > 1) | (np.diff(anchor) != 0))))
        tail = np.append(head[1:], len(starts)) - 1
        whole = rolling(part, length)
        first, more = starts[head], starts[tail] - starts[head]
        content = mixed(mixed(whole[first]) * _ODD + mixed(whole[first + more] + more.astype(np.uint64)))
        yield hashes[anchor[head]], content, text[head], first + low - offs[text[head]], anchor[head] - first, more


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries (null: empty), and where each begins and the last ends."""
    values = values.fill_null("" if pa.types.is_string(values.type) else b"").cast(pa.large_binary())
    _, where, data = values.buffers()
    offs = np.frombuffer(where, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offs[0] : offs[-1]], offs - offs[0]


def _text_runs(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Runs]]:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
        for part in text_slices(batches, "text"):
            buf, offs = _buffers(part.column("text"))
            ids, marks = part.column("doc_id").to_numpy(), part.column("mark").to_numpy()
            for anchor, content, text, *places in _runs_of(buf, offs, length):
                yield dict(zip(_RUN, (anchor, content, ids[text], marks[text], *places)))

    return runs


def _ordered(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by anchor, content, doc_id, first and mark; in it, where anchors and where contents begin; and which are later than the first of their content."""
    order = np.lexsort((runs["mark"], runs["first"], runs["doc_id"], runs["content"], runs["anchor"]))
    anchor, content = runs["anchor"][order], runs["content"][order]
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(order)]
    new = new_anchor | np.concatenate(([True], content[1:] != content[:-1]))[: len(order)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (runs["doc_id"][order] != runs["doc_id"][order][head]) | (runs["first"][order] != runs["first"][order][head])
    return order, new_anchor, new, later


def _settled(rows: DataFrame, runs: Callable[[Iterator[pa.RecordBatch]], Iterator[Runs]], buckets: int, length: int, single: bool, gathered: int, crowded: int, most_open: int) -> DataFrame:
    """_FOUND: spans of whole runs that are repeats (ahead, anchor null), and the open runs; with single, runs are strings and none is open."""

    def dealt(held: list[Runs]) -> Iterator[pa.RecordBatch]:
        all_ = {c: np.concatenate([h[c] for h in held]).astype(kind) for c, kind in _RUN.items()}
        order, new_anchor, new, later = _ordered(all_)
        group = np.cumsum(new_anchor) - 1
        # Anchors with very many different runs: these are dealt out by content, and the anchor's own bucket is told.
        many = np.bincount(group, new)[group] > crowded if len(group) and not single else np.zeros(len(group), bool)
        flags = np.where(many, _OPEN | _CROWDED, 0).astype(np.int8)
        # Of rows that share an id, equal ones count once.
        mark = all_["mark"][order]
        kept, told = np.flatnonzero(~later & (new | np.concatenate(([True], mark[1:] != mark[:-1])))), np.flatnonzero(many & new_anchor)
        anchor, content = all_["anchor"][order], all_["content"][order]
        bucket = np.concatenate((np.where(many[kept], _bucket(content[kept], buckets), _bucket(anchor[kept], buckets)), _bucket(anchor[told], buckets)))
        chosen = {c: np.concatenate((all_[c][order[kept]], all_[c][order[told]])) for c in _RUN}
        flags = np.concatenate((flags[kept], np.full(len(told), _OPEN | _CROWDED | _NEWS, np.int8)))
        # Within a bucket in the order in which texts came, which packs well.
        back = np.lexsort((np.concatenate((order[kept], order[told])), bucket))
        number, begin = np.unique(bucket[back], return_index=True)
        ends = np.append(begin[1:], len(back))
        blobs = lambda x: pa.array([x[back[a:b]].tobytes() for a, b in zip(begin, ends)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *(blobs(chosen[c]) for c in _RUN), blobs(flags)], ["bucket", *_RUN, "flags"])
        repeats = order[later]
        if len(repeats):
            own = pa.array([-1 - TaskContext.get().partitionId() % buckets], pa.int32())
            yield pa.RecordBatch.from_arrays([own, *(pa.array([all_[c][repeats].tobytes()], pa.binary()) for c in _RUN), pa.array([b""], pa.binary())], ["bucket", *_RUN, "flags"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in runs(batches):
            held.append(found)
            n += len(found["anchor"])
            if n >= gathered:
                yield from dealt(held)
                held, n = [], 0
        if n:
            yield from dealt(held)

    def told(runs_: Runs, chosen: np.ndarray, crowded_: np.ndarray | None = None) -> pa.Table:
        part = {c: x[chosen] for c, x in runs_.items()}
        open_ = crowded_ is not None
        none = pa.nulls(len(chosen))
        columns = [
            pa.array(part["doc_id"]), pa.array(part["mark"]), pa.array(part["first"]), pa.array(part["first"] + part["more"] + np.int32(length)),
            pa.array(part["ahead"]) if open_ else none.cast(pa.int32()), pa.array(part["anchor"].view(np.int64)) if open_ else none.cast(pa.int64()),
            pa.array(crowded_) if open_ else none.cast(pa.bool_()),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "mark", "begin", "end", "ahead", "anchor", "crowded"])

    def merge(table: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        all_ = {c: joined(c, kind) for c, kind in _RUN.items()}
        if table.column("bucket")[0].as_py() < 0:
            return told(all_, np.arange(len(all_["first"])))
        flags = joined("flags", np.int8)
        order, new_anchor, new, later = _ordered(all_)
        flags = flags[order]
        is_run = (flags & _NEWS) == 0
        repeats = order[later & is_run]
        if single:
            return told(all_, repeats)
        group, content = np.cumsum(new_anchor) - 1, np.cumsum(new) - 1
        # News name a run, so they can be the first of a content without being a run here.
        named = np.flatnonzero(is_run)
        heads = named[np.unique(content[named], return_index=True)[1]]
        different = np.bincount(group[heads], minlength=group[-1] + 1)
        crowded_ = (np.bincount(group, (flags & _CROWDED) != 0) > 0) | (different > most_open)
        open_ = (np.bincount(group, (flags & _OPEN) != 0) > 0) | (different > 1)
        chosen = np.flatnonzero(is_run & ~later & open_[group])
        mark, at = all_["mark"][order][chosen], content[chosen]
        chosen = chosen[np.concatenate(([True], (mark[1:] != mark[:-1]) | (at[1:] != at[:-1])))[: len(chosen)]]
        return pa.concat_tables([told(all_, repeats), told(all_, order[chosen], crowded_[group[chosen]])])

    sql = "bucket int, " + ", ".join(f"{c} binary" for c in _RUN) + ", flags binary"
    return rows.mapInArrow(deal, sql).groupBy("bucket").applyInArrow(merge, _FOUND)


def _listed(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.StructArray]:
    """The rows that a list column's items belong to, and the items."""
    lists = batch.column(column)
    return np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)), lists.flatten()


def previous_factors(anchor: np.ndarray, place: np.ndarray, ahead: np.ndarray, more: np.ndarray, buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The (run, start in it) whose longest previous factor reaches ``length``.

    Runs have an anchor, a place that orders them (equal for equal starts), the anchor's distance from their first start, the number of further starts
    and their bytes (offs: where each run's bytes begin). Starts are ordered by the place of their run, then within it.
    """
    n, none = len(anchor), np.zeros(0, np.int64)
    if not n:
        return none, none
    # Suffixes at anchors, as far as a string can reach, in words of eight bytes.
    reach = -(-length // 8) * 8
    at = offs[:-1] + ahead
    spot = at[:, None] + np.arange(reach)
    suffix = np.where((spot < offs[1:, None]) & (np.arange(reach) < length), buf[np.minimum(spot, len(buf) - 1)], 0).astype(np.uint8)
    words = np.ascontiguousarray(suffix).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], anchor))
    ranked = suffix[order]
    same = ranked[1:] == ranked[:-1]
    common = np.where(same.all(axis=1), reach, np.argmin(same, axis=1))
    common = np.where(anchor[order][1:] == anchor[order][:-1], common, 0)
    group = np.cumsum(np.concatenate(([0], anchor[order][1:] != anchor[order][:-1])))
    group_of = np.empty(n, np.int64)
    group_of[order] = group
    # left: which runs have equal bytes before their anchor, as far as the offset goes, in suffix order.
    base, left, right = order, group, np.empty(n, np.int64)
    runs, starts = [], []
    for offset in range(int(ahead.max()) + 1):
        if offset:
            byte = np.where(ahead[order] >= offset, buf[at[order] - np.minimum(offset, ahead[order])], 0).astype(np.int64)
            sort = np.argsort(group_of[order] * 256 + byte, kind="stable")
            left, byte, order = left[sort], byte[sort], order[sort]
            left = np.cumsum(np.concatenate(([0], (left[1:] != left[:-1]) | (byte[1:] != byte[:-1]))))
        who_at = np.flatnonzero((ahead[order] >= offset) & (ahead[order] - more[order] <= offset))
        if not len(who_at):
            continue
        # right: which have equal bytes from the anchor to the string's end. Neighbours equal in both have the string in common.
        right[base] = np.cumsum(np.concatenate(([0], common < length - offset)))
        who = order[who_at]
        a, b = left[who_at], right[who]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        own = place[who] + (ahead[who] - offset)
        repeated = own > np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
        runs.append(who[repeated])
        starts.append((ahead[who] - offset)[repeated])
    return (np.concatenate(runs), np.concatenate(starts)) if runs else (none, none)


def _places(doc_id: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (np.unique(doc_id, return_inverse=True)[1].astype(np.int64) << 32) + first


def _opened(open_: DataFrame, texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """bucket and the open runs with their bytes, as blobs; those of crowded anchors have bucket -1."""
    names = ["anchor", "doc_id", "mark", "first", "ahead", "more", "bytes"]
    wanted = open_.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "end", "ahead", "anchor", "crowded")).alias("runs"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            row, items = _listed(part, "runs")
            buf, offs = _buffers(part.column("text"))
            begin, end, ahead, anchor = (items.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "end", "ahead", "anchor"))
            crowded = items.field("crowded").to_numpy(zero_copy_only=False)
            number = np.where(crowded, -1, _bucket(anchor.view(np.uint64), buckets))
            back = np.argsort(number, kind="stable")
            kinds, at = np.unique(number[back], return_index=True)
            ends = np.append(at[1:], len(back))
            columns = [anchor, part.column("doc_id").to_numpy()[row], part.column("mark").to_numpy()[row], begin, ahead, end - begin - np.int32(length)]
            spans = [back[a:b] for a, b in zip(at, ends)]
            text = memoryview(np.ascontiguousarray(buf))
            a, b = offs[row] + begin, offs[row] + end
            blobs = [pa.array([x[s].tobytes() for s in spans], pa.binary()) for x in columns]
            blobs.append(pa.array([b"".join([text[i:j] for i, j in zip(a[s].tolist(), b[s].tolist())]) for s in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), *blobs], ["bucket", *names])

    return texts.join(wanted, ["doc_id", "mark"]).mapInArrow(read, "bucket int, " + ", ".join(f"{c} binary" for c in names))


def _blobs(table: pa.Table | pa.RecordBatch, length: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    kinds = {"anchor": np.int64, "doc_id": np.int64, "mark": np.int32, "first": np.int32, "ahead": np.int32, "more": np.int32, "bytes": np.uint8}
    found = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items()}
    return found, found.pop("bytes"), np.concatenate(([0], np.cumsum(found["more"].astype(np.int64) + length)))


def _spans(doc_id: np.ndarray, mark: np.ndarray, start: np.ndarray, length: int) -> pa.Table:
    """Spans of bytes of neighbouring starts of strings."""
    order = np.lexsort((start, mark, doc_id))
    doc_id, mark, start = doc_id[order], mark[order], start[order].astype(np.int32)
    new = np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (mark[1:] != mark[:-1]) | (np.diff(start) > 1)))[: len(order)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order)) - 1 if len(head) else head
    return pa.table({"doc_id": doc_id[head], "mark": mark[head], "begin": start[head], "end": start[tail] + np.int32(length)})


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gathered: int = GATHERED, crowded: int = CROWDED, most_open: int = MOST_OPEN, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """doc_id, mark, begin, end: spans of bytes that repeat earlier ones, of texts (doc_id, mark, text); spans can overlap.

    doc_id isn't null; mark tells rows of one doc_id apart.
    """
    spark, buckets = texts.sparkSession, FINER * buckets_for(texts)
    found = scratch.keep(_settled(texts, _text_runs(length), buckets, length, False, gathered, crowded, most_open))
    release(spark)
    open_ = found.where("anchor is not null")
    size = open_.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] or 0
    opened = scratch.keep(_opened(open_, texts, max(8, -(-size // open_bytes)), length))
    release(spark)

    def factors(table: pa.Table) -> pa.Table:
        runs, buf, offs = _blobs(table, length)
        which, start = previous_factors(runs["anchor"], _places(runs["doc_id"], runs["first"]), runs["ahead"].astype(np.int64), runs["more"].astype(np.int64), buf, offs, length)
        return _spans(runs["doc_id"][which], runs["mark"][which], runs["first"][which] + start, length)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
        for batch in batches:
            for i in range(batch.num_rows):
                runs, buf, offs = _blobs(batch.slice(i, 1), length)
                whole, other = rolling(_BYTE[buf], length), rolling(_BYTE[buf ^ 255], length)
                number = runs["more"].astype(np.int64) + 1
                row = np.repeat(np.arange(len(number)), number)
                at = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                zero = np.zeros(len(row), np.int32)
                yield dict(zip(_RUN, (mixed(whole[offs[row] + at]), mixed(other[offs[row] + at] * _ODD), runs["doc_id"][row], runs["mark"][row], runs["first"][row] + at, zero, zero)))

    spans = "doc_id long, mark int, begin int, end int"
    factored = opened.where("bucket >= 0").groupBy("bucket").applyInArrow(factors, spans)
    by_string = _settled(opened.where("bucket < 0"), strings, buckets, length, True, gathered, crowded, most_open)
    whole = found.where("anchor is null")
    return whole.select("doc_id", "mark", "begin", "end").unionByName(factored).unionByName(by_string.select("doc_id", "mark", "begin", "end"))


def without_repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """doc_id, text, kept (binary), spans (begin, end): each row of docs with what stays of its bytes, and the maximal spans of bytes that go.

    Null texts are empty and stay null in text; texts of fewer than ``length`` bytes lose nothing. Matches never cross texts, and are judged on the texts
    as they come. Rows that repeat a doc_id are one document: what starts at the same place in both isn't earlier in
    either. A null doc_id has no place among the others, so its text stays whole and repeats nothing. Kept bytes needn't be
    valid UTF-8. Other columns are ignored. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("mark"), F.col("text").cast("string").alias("text"))
        spans = scratch.keep(repeated_spans(texts.where("doc_id is not null and text is not null"), scratch, length, **sizes))
        release(docs.sparkSession)
        lists = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

        def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "text"):
                buf, offs = _buffers(part.column("text"))
                row, items = _listed(part, "spans")
                begin, end = (offs[row] + items.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "end"))
                depth = np.zeros(len(buf) + 1, np.int32)
                np.add.at(depth, begin, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                stays = np.flatnonzero(~gone)
                kept_offs = np.searchsorted(stays, offs)
                # A run of removed bytes begins after a byte that stays, or where its text does.
                before = np.concatenate(([False], gone[:-1]))[: len(gone)]
                before[offs[:-1][offs[:-1] < len(gone)]] = False
                first = np.flatnonzero(gone & ~before)
                after = np.concatenate((gone[1:], [False]))[: len(gone)]
                after[offs[1:][offs[1:] > 0] - 1] = False
                last = np.flatnonzero(gone & ~after) + 1
                of = np.searchsorted(offs, first, "right") - 1
                struct = pa.StructArray.from_arrays([pa.array((first - offs[of]).astype(np.int32)), pa.array((last - offs[of]).astype(np.int32))], ["begin", "end"])
                list_offs = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(part))))).astype(np.int32)
                kept = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(kept_offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[stays]))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), kept.cast(pa.binary()), pa.ListArray.from_arrays(list_offs, struct)], ["doc_id", "text", "kept", "spans"])

        joined = texts.join(lists, ["doc_id", "mark"], "left")
        return cut(joined.mapInArrow(cut_out, "doc_id long, text string, kept binary, spans array<struct<begin:int,end:int>>"))
