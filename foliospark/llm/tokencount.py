"""Token counts: whole texts encoded in batches balanced by bytes, of which only lengths leave the Python worker.

Long texts are split for the encoder at safe boundaries: single spaces between two characters that are neither white
space nor the vocabulary's space mark. A vocabulary without a piece that has the mark after another character merges
nothing across such a space, and the mark that the encoder puts before each part stands for the space itself, so the
parts' tokens are the text's. For a vocabulary with such pieces, or other settings of white space, texts stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

TOKENIZER, LIMIT = "piece_bpe_32k.model", 4096
#: Characters of a part, about, and bytes of a batch for the encoder, about.
PART, BATCH = 16_384, 262_144
_MARK = "▁"


class Counter:
    """Counts tokens as the library of a tokenizer file gives them: sentencepiece for .model, tokenizers for .json."""

    def __init__(self, path: str):
        self.splits = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
            free = not any(_MARK in p.lstrip(_MARK) for p in pieces)
            # Whether the space before a part and the mark before a text are the same, and runs of spaces are kept.
            same = self.model.encode("q") == self.model.encode(" q")[1:] or self.model.encode("a  b") != self.model.encode("a b")
            joined = self.model.encode("a") + self.model.encode("b") == self.model.encode("a b")
            self.splits = free and same and joined
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
        self.is_piece = path.endswith(".model")

    def lengths(self, texts: list[str]) -> list[int]:
        if self.is_piece:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        return [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        if not self.splits or len(text) <= PART:
            return [text]
        out, begin = [], 0
        at = text.find(" ", PART)
        while 0 <= at < len(text) - 1:
            before, after = text[at - 1], text[at + 1]
            if before.isspace() or after.isspace() or _MARK in (before, after):
                at = text.find(" ", at + 1)
            else:
                out.append(text[begin:at])
                begin = at + 1
                at = text.find(" ", begin + PART)
        return [*out, text[begin:]]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text, encoded in batches of about BATCH bytes."""
        total = np.zeros(len(texts), np.int64)
        batch: list[str] = []
        of: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                batch.append(part)
                of.append(i)
                size += len(part) if part.isascii() else len(part.encode("utf-8", "replace"))
                if size >= BATCH:
                    np.add.at(total, of, self.lengths(batch))
                    batch, of, size = [], [], 0
        if batch:
            np.add.at(total, of, self.lengths(batch))
        return total


_KNOWN: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """The counter of this Python worker, which lasts over its tasks: a vocabulary is looked through once."""
    if path not in _KNOWN:
        _KNOWN[path] = Counter(path)
    return _KNOWN[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    A null or empty text has none. Repeated rows, null ids and other columns make no difference. Texts are encoded
    whole, without added tokens. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for part in text_slices(batches, "text"):
            texts = pc.fill_null(part.column("text"), "")
            tokens = counter.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
