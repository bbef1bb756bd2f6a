"""Providers as table functions, so that SQL can call a recogniser or a model on the rows of any table.

    register_recogniser(spark, "ocr", provider)      select * from ocr(table(images))
    register_model(spark, "ask", provider)           select * from ask(table(prompts) partition by page, 'prompt')

A provider makes the function that does the work. It is called once in each Python worker, however many partitions and pages that worker sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: What providers have made in this worker.
_MADE: dict[str, Callable] = {}


def made(token: str, provider: Callable[[], Callable]) -> Callable:
    if token not in _MADE:
        _MADE[token] = provider()
    return _MADE[token]


_POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
#: Built without a session, as table functions are analysed in workers.
RECOGNISED = StructType([
    StructField("roi_x", LongType()), StructField("roi_y", LongType()), StructField("box", ArrayType(_POINT)), StructField("text", StringType()), StructField("confidence", DoubleType()),
])
_IMAGE = ["height", "width", "channels", "data"]


def register_recogniser(spark: SparkSession, name: str, provider: Callable[[], Callable[[np.ndarray], list[tuple]]], regions: Callable[[np.ndarray], list[tuple]] | None = None) -> None:
    """Makes ``name(table(images))`` give a row for each text that the provider's function finds in images (height, width, channels, data).

    The function gets a grey array and gives (box of points, text, confidence) tuples; a missing confidence counts as 0.8. regions makes the
    (x, y, w, h) of the parts of a page that are looked at; the likely text regions if it is None. All other columns of the table, whatever they are, are
    handed on with each row. Images without data have no rows.
    """
    token = uuid.uuid4().hex

    class Recogniser:
        @staticmethod
        def analyze(images: AnalyzeArgument) -> AnalyzeResult:
            if not images.isTable:
                raise ValueError(f"{name} takes a table")
            missing = [c for c in _IMAGE if c not in images.dataType.names]
            if missing:
                raise ValueError(f"{name} needs the columns {', '.join(missing)}")
            others = [f for f in images.dataType.fields if f.name not in _IMAGE]
            clashing = {f.name.lower() for f in others} & {f.name for f in RECOGNISED.fields}
            if clashing:
                raise ValueError(f"{name} makes the columns {', '.join(sorted(clashing))} itself")
            return AnalyzeResult(StructType([*others, *RECOGNISED.fields]))

        def eval(self, row: Row) -> Iterator[tuple]:
            from foliospark.operators.pixels import grey, text_rois

            if row["data"] is None:
                return
            read = made(token, provider)
            pixels = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
            page = grey(pixels) if row["channels"] >= 3 else pixels[..., 0]
            others = [row[c] for c in row.__fields__ if c not in _IMAGE]
            for x, y, w, h in (regions or text_rois)(page):
                for box, text, *sure in read(page[y : y + h, x : x + w]):
                    points = [{"x": float(p[0]), "y": float(p[1])} for p in box]
                    yield (*others, int(x), int(y), points, text, float(sure[0]) if sure else 0.8)

    spark.udtf.register(name, udtf(Recogniser))


def register_model(spark: SparkSession, name: str, provider: Callable[[], Callable[[str], str]], on_error: str = "fail") -> None:
    """Makes ``name(table(prompts), 'column')`` give each row of prompts with ``response``, the answer to that column's text.

    on_error: "fail" ends the query as soon as one request fails, "null" leaves that response null. A null prompt isn't asked.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be fail or null")
    token = uuid.uuid4().hex

    class Model:
        @staticmethod
        def analyze(prompts: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            if not prompts.isTable or not column.isConstantExpression or column.value not in prompts.dataType.names:
                raise ValueError(f"{name} takes a table and the name of one of its columns")
            if "response" in (c.lower() for c in prompts.dataType.names):
                raise ValueError(f"{name} makes the column response itself")
            return AnalyzeResult(StructType([*prompts.dataType.fields, StructField("response", StringType())]))

        def eval(self, row: Row, column: str) -> Iterator[tuple]:
            prompt, answer = row[column], None
            if prompt is not None:
                try:
                    answer = made(token, provider)(prompt)
                except Exception:
                    if on_error == "fail":
                        raise
            yield (*row, answer)

    spark.udtf.register(name, udtf(Model))
