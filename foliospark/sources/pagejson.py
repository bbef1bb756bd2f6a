"""A sink that writes one JSON file for each page, indented by two spaces, in UTF-8 with all characters as they are.

    write_documents(page_documents, path, "vision_analysis_results.json")

Each task writes to a folder of its own, beside where the files will be; tasks that are tried again or run twice have other folders. Once all
tasks have ended, the driver moves those that count (one name for each task, never pages) to ``part-…`` folders and puts the whole in place of what was
there with one move. A job that fails or is killed leaves the earlier files as they were.

Folders are reached with pyarrow's file systems: a path, or a URI of file, hdfs, s3 or gs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def pretty(document: str) -> bytes:
    """A JSON text with each value on a line of its own, as it is written to a page's file."""
    return json.dumps(json.loads(document), indent=2, ensure_ascii=False).encode("utf-8")


@dataclass
class _Written(WriterCommitMessage):
    part: str
    folder: str


class PageJsonWriter(DataSourceWriter):
    def __init__(self, path: str, name: str, overwrite: bool):
        self.path, self.name, self.overwrite = path.rstrip("/"), name, overwrite
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, root = fs.FileSystem.from_uri(self.staged)
        part = f"part-{TaskContext.get().partitionId():05}"
        folder = f"{part}-{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{folder}", recursive=True)
        for image_id, document in rows:
            with files.open_output_stream(f"{root}/{folder}/{image_id}.{self.name}") as out:
                out.write(pretty(document))
        return _Written(part, folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, staged = fs.FileSystem.from_uri(self.staged)
        path = fs.FileSystem.from_uri(self.path)[1]
        there = files.get_file_info(path).type != fs.FileType.NotFound
        if there and not self.overwrite:
            # Beside what is there: each task's folder by itself, under a name that no other job has.
            for m in filter(None, messages):
                files.move(f"{staged}/{m.folder}", f"{path}/{m.folder}")
            files.delete_dir(staged)
            return
        made = f"{staged}-whole"
        files.create_dir(made, recursive=True)
        for m in filter(None, messages):
            files.move(f"{staged}/{m.folder}", f"{made}/{m.part}")
        aside = f"{staged}-before"
        if there:
            files.move(path, aside)
        files.move(made, path)
        for folder in [staged, aside]:
            if files.get_file_info(folder).type != fs.FileType.NotFound:
                files.delete_dir(folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, staged = fs.FileSystem.from_uri(self.staged)
        if files.get_file_info(staged).type != fs.FileType.NotFound:
            files.delete_dir(staged)


class PageJson(DataSource):
    """Format ``page_json``; options: path, and name, which each file's name ends with after the page's id."""

    @classmethod
    def name(cls) -> str:
        return "page_json"

    def writer(self, schema: StructType, overwrite: bool) -> PageJsonWriter:
        if [f.dataType.typeName() for f in schema.fields] != ["long", "string"]:
            raise ValueError("page_json takes image_id (long) and document (JSON text)")
        return PageJsonWriter(self.options["path"], self.options.get("name", "json"), overwrite)


def write_documents(documents: DataFrame, path: str, name: str) -> None:
    """Writes documents (image_id, document: JSON text, one row a page) in place of what is at path.

    A null document is the JSON null. Rows of one page in one partition overwrite each other. An empty table makes an empty folder.
    """
    documents.sparkSession.dataSource.register(PageJson)
    rows = documents.select(F.col("image_id").cast("long").alias("image_id"), F.coalesce("document", F.lit("null")).alias("document"))
    rows.write.format("page_json").option("name", name).mode("overwrite").save(path)


def write_region_texts(texts: DataFrame, path: str) -> None:
    """One array of region texts for each page, of page_texts(): image_id, texts."""
    write_documents(texts.select("image_id", F.to_json("texts").alias("document")), path, "ocr_results.json")


def write_vision_documents(made: DataFrame, path: str) -> None:
    """One document for each page, of vision_documents(): total_regions, and the regions with whole numbers as bounds."""
    region = F.transform("regions", lambda r: r.withField("bounds", F.struct(*(r["bounds"][c].cast("long").alias(c) for c in ("top", "bottom", "left", "right")))))
    write_documents(made.select("image_id", F.to_json(F.struct("total_regions", region.alias("regions")), {"ignoreNullFields": "false"}).alias("document")), path, "vision_analysis_results.json")
