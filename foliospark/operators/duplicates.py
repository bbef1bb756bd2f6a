"""Duplicate texts of a page: leader clustering by similarity of texts or overlap of boxes, from candidates that filters let pass.

difflib's ratio exceeds a threshold t only if the blocks that it matches have M > t * S / 2 characters, S being both lengths together. For that

* the shorter text must have as many characters;
* both must have as many characters in common, counted with repeats;
* both must have 3 M - S - 1 pairs of neighbouring characters in common: M characters in B blocks hold M - B pairs, and between two blocks there is at
  least one of the S - 2 M characters that aren't matched;
* they must have a common subsequence of as many characters, whose length takes a few operations on whole numbers for each character.

Distinct texts of a page are sorted by length, so the first filter is a window; the others compare counts of characters and of pairs in a few
columns each (several characters may share one, which lets more pass and none less). Only what passes these is compared by the fourth and then by difflib, and
only with texts that have become seeds. Boxes that overlap are found by a window over their tops.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import PAIRS, _whole_pages

#: Columns for counts of characters and of pairs; from so many partners on a text is compared with its whole window at once.
LETTERS, NEIGHBOURS, MANY = 64, 128, 256
#: Longer texts have counts that the columns can't hold: they pass the second and third filter.
_LONG = 1 << 16


def windows(key: np.ndarray, last: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, with key[j] <= last[i], of ascending keys; those of about PAIRS pairs at a time, and of any i with more than ``most`` by itself."""
    n = len(key)
    count = np.maximum(np.searchsorted(key, last, "right") - np.arange(1, n + 1), 0)
    many = count > most
    ends = np.cumsum(np.where(many, 0, count))
    at = 0
    while at < n and ends[-1]:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = np.where(many[at:to], 0, count[at:to])
        i = np.repeat(np.arange(at, to), own)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        at = to
    for i in np.flatnonzero(many):
        yield np.array([i]), np.arange(i + 1, i + 1 + count[i])


class _Texts:
    """Counts of the characters and pairs of distinct texts, a row for each."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.letters = np.zeros((len(texts), LETTERS), np.uint16)
        self.pairs = np.zeros((len(texts), NEIGHBOURS), np.uint16)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(np.cumsum(self.lengths[at:]), PAIRS)) + at)
            points = np.frombuffer("".join(texts[at:to]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            of = np.repeat(np.arange(to - at), self.lengths[at:to])
            counted = lambda rows, values, width: np.minimum(np.bincount(rows * width + values % width, minlength=(to - at) * width), _LONG - 1).reshape(-1, width)  # noqa: B023, E731
            self.letters[at:to] = counted(of, points ^ (points >> 5), LETTERS)
            inside = of[1:] == of[:-1]
            self.pairs[at:to] = counted(of[1:][inside], (points[:-1] * 31 + points[1:])[inside], NEIGHBOURS)
            at = to

    def may_exceed(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Of pairs of rows, i one row or as many as j, which may have a ratio above least."""
        total = self.lengths[i] + self.lengths[j]
        matched = np.floor(least * total / 2 - 1e-9).astype(np.int64) + 1
        ok = np.minimum(self.lengths[i], self.lengths[j]) >= matched
        long_ = np.maximum(self.lengths[i], self.lengths[j]) >= _LONG
        for counts, needed in ((self.letters, matched), (self.pairs, 3 * matched - total - 1)):
            open_ = np.flatnonzero(ok & ~long_)
            own = counts[i] if len(i) == 1 else counts[i[open_]]
            ok[open_] = np.minimum(counts[j[open_]], own).sum(axis=1, dtype=np.int64) >= needed[open_]
        return ok


def alike_texts(page: np.ndarray, code: np.ndarray, texts: _Texts, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of distinct (page, code) whose texts may have a ratio above least."""
    order = np.lexsort((texts.lengths[code], page))
    length = texts.lengths[code][order]
    room = int(length.max()) + 1
    reach = np.minimum(np.floor(length * (2 - least) / least + 1e-6), room - 1).astype(np.int64) if least > 0 else np.full(len(order), room - 1)
    codes = code[order]
    for i, j in windows(page[order] * room + length, page[order] * room + reach, MANY):
        found = texts.may_exceed(codes[i], codes[j], least)
        yield order[np.broadcast_to(i, len(j))[found]], order[j[found]]


def overlapping_boxes(page: np.ndarray, boxes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a page whose boxes (left, top, right, bottom) share more than ``least`` of the smaller one's area (of 1 if one has none)."""
    rows = np.flatnonzero(~np.isnan(boxes).any(axis=1))
    if not len(rows):
        return
    rows = rows[np.lexsort((boxes[rows, 1], page[rows]))]
    left, top, right, bottom = boxes[rows].T
    low = top.min()
    room = max(float(bottom.max()), float(top.max())) - low + 1
    area = (right - left) * (bottom - top)
    for i, j in windows(page[rows] * room + (top - low), page[rows] * room + (np.maximum(bottom, top) - low), 1 << 62):
        common = np.maximum(0, np.minimum(right[i], right[j]) - np.maximum(left[i], left[j])) * np.maximum(0, np.minimum(bottom[i], bottom[j]) - np.maximum(top[i], top[j]))
        smaller = np.where((area[i] != 0) & (area[j] != 0), np.minimum(area[i], area[j]), 1)
        found = common / smaller > least
        yield rows[i[found]], rows[j[found]]


def _partners(pairs: Iterator[tuple[np.ndarray, np.ndarray]], both: bool) -> dict[int, list[int]]:
    """For each row the ascending ones that it is paired with; unless both, only those before it."""
    found = list(pairs)
    a, b = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    a, b = (np.concatenate((a, b)), np.concatenate((b, a))) if both else (np.minimum(a, b), np.maximum(a, b))
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    own, at = np.unique(b, return_index=True)
    return {k: part.tolist() for k, part in zip(own.tolist(), np.split(a, at[1:]))}


class _Subsequences:
    """Lengths of longest common subsequences with one text: a bit for each of its characters tells where the length grows."""

    def __init__(self, text: str):
        self.size, self.places = len(text), {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def common(self, other: str, least: int = 0) -> int:
        """The length, or less than ``least`` as soon as it is known to be less."""
        whole = rest = (1 << self.size) - 1
        places, left = self.places.get, len(other)
        for at in range(0, left, 24):
            for c in other[at : at + 24]:
                met = rest & places(c, 0)
                rest = (rest + met | rest - met) & whole
            if self.size - rest.bit_count() + left - at - 24 < least:
                break
        return self.size - rest.bit_count()


def _exceeds(seed: str, other: str, subsequences: _Subsequences, least: float) -> bool:
    needed = math.floor(least * (len(seed) + len(other)) / 2 - 1e-9) + 1
    if subsequences.common(other, needed) < needed:
        return False
    return difflib.SequenceMatcher(None, seed, other).ratio() > least


def leaders_of(page: np.ndarray, code: np.ndarray, texts: list[str], boxes: np.ndarray, similarity: float, overlap: float) -> np.ndarray:
    """For each row, in the order in which rows come, the first seed of its page that it resembles, or itself: a new seed.

    code: each row's number in texts, -1 for none; rows without a text are resembled by overlap alone.
    """
    n = len(page)
    has = np.flatnonzero(code >= 0)
    width = len(texts) + 1
    distinct, of = np.unique(page[has] * width + code[has], return_inverse=True)
    text_of = np.full(n, -1)
    text_of[has] = of
    told = distinct % width
    alike = _partners(alike_texts(distinct // width, told, _Texts(texts), similarity), True) if len(has) else {}
    over = _partners(overlapping_boxes(page, boxes, overlap), False)
    owner = np.arange(n)
    seed_of: dict[int, int] = {}
    similar: dict[tuple[int, int], bool] = {}
    common: dict[int, _Subsequences] = {}
    equal = 1.0 > similarity
    for row, own in enumerate(text_of.tolist()):
        first = next((s for s in over.get(row, ()) if owner[s] == s), n)
        if own >= 0:
            if equal:
                first = min(first, seed_of.get(own, n))
            for other in alike.get(own, ()):
                seed = seed_of.get(other, n)
                if seed < first:
                    if (other, own) not in similar:
                        text = texts[told[other]]
                        if other not in common:
                            common[other] = _Subsequences(text)
                        similar[other, own] = _exceeds(text, texts[told[own]], common[other], similarity)
                    if similar[other, own]:
                        first = seed
            if first == n:
                seed_of.setdefault(own, row)
        owner[row] = min(first, row)
    return owner


def without_duplicate_texts(blocks: DataFrame, similarity: float = 0.8, overlap: float = 0.5) -> DataFrame:
    """image_id, seed_id, element_id (kept), group_size: one text of each group of similar or overlapping ones.

    Groups have as seed the first of their texts in the order of element_id, which is that of recognition, and as result the most
    confident, ties to the earlier; a null confidence is least. Null texts and null boxes resemble nothing by themselves. The unit is a page.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_pages(batches):
            whole = lambda c: table.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
            image, element = whole("image_id"), whole("element_id")
            order = np.lexsort((element, image))
            encoded = table.column("text").combine_chunks().dictionary_encode()
            code = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[order]
            boxes = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float)[order] for c in ("left_x", "top_y", "right_x", "bottom_y")], axis=1)
            image, element = image[order], element[order]
            owner = leaders_of(np.unique(image, return_inverse=True)[1], code, encoded.dictionary.to_pylist(), boxes, similarity, overlap)
            sure = table.column("confidence")
            none = sure.is_null().to_numpy(zero_copy_only=False)[order]
            # As in comparisons of SQL: null is least, NaN greatest.
            sure = np.where(none, -np.inf, np.nan_to_num(sure.to_numpy(zero_copy_only=False).astype(float)[order], nan=np.inf, posinf=np.inf, neginf=-np.inf))
            by_group = np.lexsort((np.arange(len(owner)), -sure, none, owner))
            seeds, first, size = np.unique(owner[by_group], return_index=True, return_counts=True)
            columns = [image[seeds], element[seeds], element[by_group[first]], size.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["image_id", "seed_id", "element_id", "group_size"])

    rows = blocks.select("image_id", "element_id", F.col("text").cast("string").alias("text"), F.col("confidence").cast("double").alias("confidence"), "left_x", "top_y", "right_x", "bottom_y")
    return rows.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(group, "image_id long, seed_id long, element_id long, group_size long")
