"""Quality rules: repetition coverage, by rolling hashes of several n-gram lengths and of lines.

For each text the rules measure which share of its word characters lies inside n-grams of words that occur twice or
more in it (all occurrences), for several n, and which share of its characters lies inside lines that repeat an
earlier line. Texts that exceed a threshold are rejected, besides the base rules (too few words, too many words in
repeated 8-word windows). Everything about a text is known from that text, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEADS, Block, mixed, rolling, span_hashes, span_sums, text_slices

#: Most per cent of word characters inside repeated n-grams, by n.
COVERAGE = {5: 40, 8: 35, 10: 30}
#: Most per cent of characters inside lines equal to an earlier one.
LINE_COVERAGE = 30
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Fixed value: the symbols of the contract.
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_windows(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that occurs twice or more in its text. of: each word's text."""
    inside = np.zeros(len(hashes) + 1, np.int32)
    if len(hashes) >= n:
        m = len(hashes) - n + 1
        rolled = rolling(hashes, n)
        whole = np.flatnonzero(of[:m] == of[n - 1 :])
        keys = mixed(rolled[whole] + mixed(of[whole].astype(np.uint64)))
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        again = np.zeros(len(keys), bool)
        again[1:] |= same
        again[:-1] |= same
        found = whole[order[again]]
        np.add.at(inside, found, 1)
        np.add.at(inside, found + n, -1)
    return np.cumsum(inside[:-1]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of each text, char_lines (characters in lines that repeat an earlier one) and chars_<n>."""
    block = Block(texts)
    leads = LEADS[block.buf]
    hashes = block.word_hashes()
    of = np.repeat(np.arange(block.n), block.n_words)
    chars = span_sums(leads, block.starts, block.ends)

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[block.first[1:]] - total[block.first[:-1]]

    symbol = np.zeros(256, np.uint8)
    symbol[list(SYMBOLS)] = 1
    out = {"n_words": block.n_words, "word_chars": sums(chars), "n_symbols": block.per_text(symbol[block.buf])}

    # Lines: each ends with \n, the last by what the block adds.
    ends = np.flatnonzero(block.buf == 10) + 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    has_word = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_of = np.searchsorted(block.offs, starts, "right") - 1
    if len(starts):
        keys = mixed(span_hashes(block.buf, starts, ends) + mixed(line_of.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        starts, ends, line_of = starts[again], ends[again], line_of[again]
    out["n_dup_lines"] = np.bincount(line_of, minlength=block.n).astype(np.int64)
    out["char_lines"] = np.zeros(block.n, np.int64)
    np.add.at(out["char_lines"], line_of, span_sums(leads, starts, ends) - 1)
    out["n_chars"] = block.per_text(leads) - 1
    out["n_repeat_words"] = np.zeros(block.n, np.int64)
    for n in sorted({*COVERAGE, WINDOW}):
        inside = repeated_windows(hashes, of, n)
        if n == WINDOW:
            out["n_repeat_words"] = sums(inside)
        out[f"chars_{n}"] = sums(chars * inside)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed, kept."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (100 * m["char_lines"] <= LINE_COVERAGE * m["n_chars"])
    for n, most in COVERAGE.items():
        kept &= 100 * m[f"chars_{n}"] <= most * m["word_chars"]
    return failed, kept


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and as the method's figures the covered characters, for each row.

    A null, empty or blank text has no words and fails the base rules. Repeated rows, null ids and other columns
    make no difference; whole texts are measured, however long. An empty table gives an empty result.
    """
    extra = ["char_lines", *(f"chars_{n}" for n in COVERAGE)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            m = measure(part.column("text"))
            failed, kept = verdicts(m)
            columns = {"doc_id": part.column("doc_id")} | {k: pa.array(m[k].astype(np.int64)) for k in (*MEASURES, *extra)}
            yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "kept": pa.array(kept)})

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in (*MEASURES, *extra)) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns whatever their names, whose text is kept.

    Null, empty and blank texts go. Null ids and repeated rows make no difference. An empty table gives an empty result.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            yield part.filter(pa.array(verdicts(measure(part.column("text")))[1]))

    return docs.mapInArrow(keep, docs.schema)
