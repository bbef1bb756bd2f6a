"""Element tables: the working schema, fixture views over the driver's tables, and image scans.

Elements: image_id, element_id (key), type ('text' or 'image'), text, confidence, left_x, top_y, right_x, bottom_y.
The views are pure projections, so filters and column choices reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = (
    "image_id bigint, element_id bigint, type string, text string, confidence double, "
    "left_x bigint, top_y bigint, right_x bigint, bottom_y bigint"
)


def layout_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """One element for each event, one page for each user; dense: on a small canvas, so that many boxes overlap."""
    width, height = (400, 600) if dense else (1600, 6000)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(
        "user_id as image_id",
        "event_id as element_id",
        "case when event_id % 5 = 0 then 'image' else 'text' end as type",
        "concat(event_type, ' ', cast(event_id % 17 as string)) as text",
        "cast((event_id * 13) % 100 as double) / 100 as confidence",
        f"cast((event_id * 7919) % {width} as bigint) as left_x",
        f"cast((event_id * 104729) % {height} as bigint) as top_y",
        f"cast((event_id * 7919) % {width} + 20 + (event_id * 31) % 180 as bigint) as right_x",
        f"cast((event_id * 104729) % {height} + 10 + (event_id * 17) % 40 as bigint) as bottom_y",
    )


def events_sql(dense: bool = False) -> str:
    width, height = (400, 600) if dense else (1600, 6000)
    return f"""select user_id as image_id, event_id as element_id,
        case when event_id % 5 = 0 then 'image' else 'text' end as type,
        concat(event_type, ' ', cast(event_id % 17 as varchar)) as text,
        cast((event_id * 13) % 100 as double) / 100 as confidence,
        cast((event_id * 7919) % {width} as bigint) as left_x, cast((event_id * 104729) % {height} as bigint) as top_y,
        cast((event_id * 7919) % {width} + 20 + (event_id * 31) % 180 as bigint) as right_x,
        cast((event_id * 104729) % {height} + 10 + (event_id * 17) % 40 as bigint) as bottom_y
      from events"""


def layout_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text element for each line of two characters or more of each document, in two columns with a gap every ten lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n"))).selectExpr("doc_id", "cast(pos as bigint) as ln", "trim(col) as line")
    return lines.where("length(line) >= 2").selectExpr(
        "doc_id as image_id",
        "ln as element_id",
        "'text' as type",
        "line as text",
        "cast((doc_id * 31 + ln * 17) % 100 as double) / 100 as confidence",
        "cast(40 + (ln % 2) * 700 + (ln * 7) % 30 as bigint) as left_x",
        "cast(20 + (ln div 2) * 28 + (ln div 10) * 60 as bigint) as top_y",
        "cast(40 + (ln % 2) * 700 + (ln * 7) % 30 + least(600, 8 * length(line)) as bigint) as right_x",
        "cast(20 + (ln div 2) * 28 + (ln div 10) * 60 + 20 as bigint) as bottom_y",
    )


DOCS_SQL = """select doc_id as image_id, ln as element_id, 'text' as type, line as text,
        cast((doc_id * 31 + ln * 17) % 100 as double) / 100 as confidence,
        cast(40 + (ln % 2) * 700 + (ln * 7) % 30 as bigint) as left_x,
        cast(20 + (ln // 2) * 28 + (ln // 10) * 60 as bigint) as top_y,
        cast(40 + (ln % 2) * 700 + (ln * 7) % 30 + least(600, 8 * length(line)) as bigint) as right_x,
        cast(20 + (ln // 2) * 28 + (ln // 10) * 60 + 20 as bigint) as bottom_y
      from (select doc_id, cast(ln as bigint) as ln, trim(line, ' ') as line from (
        select doc_id, unnest(range(len(parts))) as ln, unnest(parts) as line
        from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null))) where length(line) >= 2"""


def images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """image_id (a hash of the path), path, content of image files; unreadable images are left to the decoder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, path, height, width, channels, data (BGR rows) of image files; with dropInvalid, unreadable ones go."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object candidates at three scales, from events: image_id, cand_id, scale, x, y, w, h, edge_density, text_density."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "user_id as image_id", "event_id as cand_id",
        "case event_id % 3 when 0 then cast(1.0 as double) when 1 then cast(0.75 as double) else cast(0.5 as double) end as scale",
        "cast((event_id * 7919) % 1600 as bigint) as x", "cast((event_id * 104729) % 6000 as bigint) as y",
        "cast(20 + (event_id * 31) % 180 as bigint) as w", "cast(10 + (event_id * 17) % 140 as bigint) as h",
        "cast((event_id * 7) % 50 as double) / 100 as edge_density", "cast((event_id * 11) % 60 as double) / 100 as text_density",
    )


CANDIDATES_SQL = """select user_id as image_id, event_id as cand_id,
        case event_id % 3 when 0 then cast(1.0 as double) when 1 then cast(0.75 as double) else cast(0.5 as double) end as scale,
        cast((event_id * 7919) % 1600 as bigint) as x, cast((event_id * 104729) % 6000 as bigint) as y,
        cast(20 + (event_id * 31) % 180 as bigint) as w, cast(10 + (event_id * 17) % 140 as bigint) as h,
        cast((event_id * 7) % 50 as double) / 100 as edge_density, cast((event_id * 11) % 60 as double) / 100 as text_density
      from events"""
