"""Output documents: region texts, vision documents, dash segments, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The prompts and what takes an analysis' place when it fails.
REGION_PROMPT = "Describe the visual layout and content of this region. Focus on the spatial arrangement and visual elements:"
SUMMARY_PROMPT = "Based on these sections, provide a comprehensive analysis:"
SUMMARY_FAILED = "Error generating final analysis"
MODEL = "llama3.2-vision:11b"


def _ordered(value: str, *order: str) -> Column:
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return F.transform(packed, lambda s: s["__v"])


def region_texts(paragraphs: DataFrame) -> DataFrame:
    """image_id, group_id, text: each region's paragraphs joined by a space."""
    return paragraphs.groupBy("image_id", "group_id").agg(F.array_join(_ordered("text", "para_no"), " ").alias("text"))


def page_texts(paragraphs: DataFrame) -> DataFrame:
    """image_id, texts: the array of a page's region texts from the top, as one JSON document each."""
    return region_texts(paragraphs).groupBy("image_id").agg(_ordered("text", "group_id").alias("texts"))


def vision_documents(boxes: DataFrame, descriptions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """image_id, total_regions, regions: nested documents of regions that have a description.

    Regions keep their numbers, so a page may have gaps where a region had no picture; the total counts those there are.
    """
    texts = paragraphs.groupBy("image_id", "group_id").agg(_ordered("text", "para_no").alias("merged_paragraphs"))
    rows = boxes.join(descriptions, ["image_id", "group_id"]).join(texts, ["image_id", "group_id"], "left")
    region = F.struct(
        F.col("group_id").alias("region_id"),
        F.struct(F.col("top_y").alias("top"), F.col("bottom_y").alias("bottom"), F.col("left_x").alias("left"), F.col("right_x").alias("right")).alias("bounds"),
        F.col("description").alias("vision_description"),
        F.struct(F.array().cast("array<array<struct<text:string,v_center:double,left:double,avg_right:double>>>").alias("columns"), F.coalesce("merged_paragraphs", F.array().cast("array<string>")).alias("merged_paragraphs")).alias("text_content"),
    )
    return rows.groupBy("image_id").agg(F.count("*").alias("total_regions"), F.array_sort(F.collect_list(region)).alias("regions"))


def region_dump(elements: DataFrame, boxes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """image_id, regions: each page's regions with their elements (with group_id), nested, in order: for as_json() and write_json().

    Regions without paragraphs have an empty list of them.
    """
    box = lambda: F.struct(F.col("left_x").alias("left"), F.col("right_x").alias("right"), F.col("top_y").alias("top"), F.col("bottom_y").alias("bottom"))
    element = F.struct("element_id", "type", "text", "confidence", box().alias("bounds"))
    inner = elements.groupBy("image_id", "group_id").agg(F.array_sort(F.collect_list(element)).alias("elements"))
    texts = paragraphs.groupBy("image_id", "group_id").agg(_ordered("text", "para_no").alias("merged_paragraphs"))
    rows = boxes.join(inner, ["image_id", "group_id"]).join(texts, ["image_id", "group_id"], "left")
    none = F.array().cast("array<string>")
    region = F.struct(F.col("group_id").alias("region_id"), box().alias("bounds"), "elements", F.coalesce("merged_paragraphs", none).alias("merged_paragraphs"))
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))


def report(paragraphs: DataFrame) -> DataFrame:
    """image_id, line_no, line: the merged paragraphs of each page's regions as lines of a report."""
    place = F.dense_rank().over(Window.partitionBy("image_id").orderBy("group_id"))
    own = F.row_number().over(Window.partitionBy("image_id", "group_id").orderBy("para_no"))
    rows = paragraphs.select("image_id", "group_id", place.alias("region"), own.alias("paragraph"), "text")
    head = F.concat(F.lit("Region Group "), F.col("region"), F.lit(" (ID="), F.col("group_id"), F.lit("):"))
    heads = rows.where("paragraph = 1").select("image_id", "region", F.lit(0).alias("paragraph"), head.alias("line"))
    lines = rows.select("image_id", "region", "paragraph", F.concat(F.lit("  Paragraph "), F.col("paragraph"), F.lit(": "), F.col("text")).alias("line"))
    order = Window.partitionBy("image_id").orderBy("region", "paragraph")
    return heads.union(lines).select("image_id", F.row_number().over(order).cast("long").alias("line_no"), "line")


def print_report(paragraphs: DataFrame, write: Callable[[str], object] = print) -> None:
    """Writes the report's lines, page by page, as they arrive: one partition's lines are on the driver at a time."""
    for row in report(paragraphs).orderBy("image_id", "line_no").toLocalIterator():
        write(row.line)


def as_json(documents: DataFrame) -> DataFrame:
    """image_id and the document as one JSON string."""
    fields = [c for c in documents.columns if c != "image_id"]
    return documents.select("image_id", F.to_json(F.struct(*fields)).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in place of what was there; nothing is written for an empty table's rows."""
    df.write.mode("overwrite").json(path)


def dash_segments(boxes: DataFrame, dash: int = 20) -> DataFrame:
    """image_id, group_id, side, dash, x1, y1, x2, y2: the dashes of each box's outline, sides clockwise from the top.

    Sides without length have none. Ends are cut towards 0.
    """
    sides = "stack(4, 0, left_x, top_y, right_x, top_y, 1, right_x, top_y, right_x, bottom_y, 2, right_x, bottom_y, left_x, bottom_y, 3, left_x, bottom_y, left_x, top_y) as (side, px, py, qx, qy)"
    rows = boxes.selectExpr("image_id", "group_id", sides).selectExpr("*", "qx - px as dx", "qy - py as dy", "sqrt(cast((qx - px) * (qx - px) + (qy - py) * (qy - py) as double)) as dist")
    rows = rows.where("dist > 0").selectExpr("*", f"explode(sequence(0, greatest(cast(dist / {2 * dash} as int), 1) - 1)) as dash")
    rows = rows.selectExpr("*", f"dash * {2 * dash} / dist as s", f"least((dash * 2 + 1) * {dash} / dist, 1.0D) as e")
    ends = [f"cast({p} + {d} * {r} as bigint) as {n}" for n, p, d, r in (("x1", "px", "dx", "s"), ("y1", "py", "dy", "s"), ("x2", "px", "dx", "e"), ("y2", "py", "dy", "e"))]
    return rows.selectExpr("image_id", "group_id", "cast(side as bigint) as side", "cast(dash as bigint) as dash", *ends)


def _message(*content: Column) -> Column:
    return F.to_json(F.struct(F.lit(MODEL).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.array(*content).alias("content"))).alias("messages")))


def region_prompts(crops: DataFrame, media: str = "image/jpeg") -> DataFrame:
    """image_id, group_id, prompt: the request for each encoded picture (binary column picture) of that media type."""
    url = F.concat(F.lit(f"data:{media};base64,"), F.regexp_replace(F.base64("picture"), r"[\r\n]", ""))
    none = F.lit(None).cast("string")
    text = F.struct(F.lit("text").alias("type"), F.lit(REGION_PROMPT).alias("text"), none.alias("image_url"))
    picture = F.struct(F.lit("image_url").alias("type"), none.alias("text"), url.alias("image_url"))
    return crops.select("image_id", "group_id", _message(text, picture).alias("prompt"))


def summary_texts(descriptions: DataFrame) -> DataFrame:
    """image_id, text: what the analysis of a whole page is asked, with all its sections in order."""
    section = F.transform(_ordered("description", "group_id"), lambda d, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(": "), d))
    asked = F.concat(F.lit(SUMMARY_PROMPT + "\n\n"), F.array_join(section, "\n\n"))
    return descriptions.where("description is not null").groupBy("image_id").agg(asked.alias("text"))


def summary_prompts(descriptions: DataFrame) -> DataFrame:
    """image_id, prompt."""
    return summary_texts(descriptions).select("image_id", _message(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("prompt"))


def response_text(response: str) -> Column:
    """The text of a chat response in JSON, null if there is none."""
    return F.get_json_object(F.col(response), "$.choices[0].message.content")


def answered(prompts: DataFrame, provider: Callable[[], Callable[[str], str]], key: str, on_error: str = "fail", concurrency: int | None = None) -> DataFrame:
    """prompts with ``response``: what a provider answers, made once for each partition and asked row by row.

    provider makes the function from prompt to response in the worker. on_error: "fail" ends the job as soon as one
    request fails, "null" leaves that response null. concurrency: the number of partitions, so of requests at a time.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be fail or null")
    if concurrency:
        prompts = prompts.repartition(concurrency)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for pdf in frames:
            call = call or provider()
            out: list[str | None] = []
            for prompt in pdf[key]:
                try:
                    out.append(call(prompt))
                except Exception:
                    if on_error == "fail":
                        raise
                    out.append(None)
            yield pdf.assign(response=pd.Series(out, dtype=object))

    schema = StructType([*prompts.schema.fields, StructField("response", StringType())])
    return prompts.mapInPandas(ask, schema)


def http_chat(url: str = "http://localhost:11434/v1/chat/completions", timeout: float = 120.0) -> Callable[[], Callable[[str], str]]:
    """A provider that posts prompts to an OpenAI-style endpoint."""

    def make() -> Callable[[str], str]:
        import urllib.request

        def call(prompt: str) -> str:
            request = urllib.request.Request(url, prompt.encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.read().decode()

        return call

    return make
