"""A ledger of answers: what a model was asked is kept with its answer, and never asked again.

An answer's key is the SHA-256 of its prompt, which names the model. Answers of finished jobs are a Parquet table, ``answers``. While a job runs, each
answer is stored as soon as it is there, as an object of its own under ``objects``, named by its key. A task that is tried again, or a job that is started
again after it was killed, finds these and asks only what is still open.

The folder is reached with pyarrow's file systems from tasks (a path, or a URI of file, hdfs, s3 or gs) and with Spark from the driver. One job at
a time writes to a ledger.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import remove, unused

_SCHEMA = "digest string, response string"


class _Objects:
    """Answers as single objects: a key's object is there whole or not at all."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def _place(self, digest: str) -> str:
        return f"{self.root}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> str | None:
        if self.files.get_file_info(self._place(digest)).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(self._place(digest)) as stream:
            return json.loads(stream.read())["response"]

    def put(self, digest: str, response: str) -> None:
        part = f"{self.root}/.{uuid.uuid4().hex}"
        self.files.create_dir(f"{self.root}/{digest[:2]}", recursive=True)
        with self.files.open_output_stream(part) as stream:
            stream.write(json.dumps({"digest": digest, "response": response}).encode())
        self.files.move(part, self._place(digest))


class Ledger:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _has(self, spark: SparkSession, name: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def answers(self, spark: SparkSession) -> DataFrame:
        """digest, response: all answers there are, those of unfinished jobs included; each digest once."""
        found = spark.createDataFrame([], _SCHEMA)
        if self._has(spark, "answers"):
            found = found.union(spark.read.schema(_SCHEMA).parquet(f"{self.path}/answers"))
        if self._has(spark, "objects"):
            found = found.union(spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").json(f"{self.path}/objects"))
        return found.groupBy("digest").agg(F.min("response").alias("response"))

    def settle(self, spark: SparkSession) -> None:
        """Moves the answers of unfinished jobs to the table. Should this be killed, some answers are in both: they count once."""
        if self._has(spark, "objects"):
            left = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").json(f"{self.path}/objects")
            if self._has(spark, "answers"):
                left = left.join(spark.read.schema(_SCHEMA).parquet(f"{self.path}/answers").select("digest"), "digest", "left_anti")
            left.write.mode("append").parquet(f"{self.path}/answers")
            remove(spark, f"{self.path}/objects")

    def answered(self, prompts: DataFrame, provider: Callable[[], Callable[[str], str]], key: str = "prompt", on_error: str = "fail", concurrency: int | None = None) -> DataFrame:
        """prompts with ``response``: what the ledger has for the key column's text, or what a provider answers now.

        Equal prompts are asked once, known ones not at all. provider makes the function from prompt to response, once for each partition.
        on_error: "fail" ends the job as soon as one request fails, and keeps the answers until then; "null" leaves that response null and open, so the next
        job asks again. concurrency: the number of requests at a time. A null prompt isn't asked and has a null response. Names of the
        other columns are free.
        """
        if on_error not in ("fail", "null"):
            raise ValueError("on_error must be fail or null")
        spark, root = prompts.sparkSession, f"{self.path}/objects"
        self.settle(spark)
        digest, of, response = unused(prompts.columns, "digest", "of", "response")
        keyed = prompts.withColumn(digest, F.sha2(F.col(key), 256))
        distinct = keyed.where(F.col(key).isNotNull()).groupBy(F.col(digest).alias("digest")).agg(F.min(key).alias("prompt"))
        open_ = distinct.join(self.answers(spark).select("digest"), "digest", "left_anti")
        if concurrency:
            open_ = open_.repartition(concurrency)

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, objects = None, _Objects(root)
            for pdf in frames:
                out: list[str | None] = []
                for one, prompt in zip(pdf["digest"], pdf["prompt"]):
                    # A try of this task that was lost may have asked already.
                    answer = objects.get(one)
                    if answer is None:
                        call = call or provider()
                        try:
                            answer = call(prompt)
                        except Exception:
                            if on_error == "fail":
                                raise
                        else:
                            objects.put(one, answer)
                    out.append(answer)
                yield pd.DataFrame({"digest": pdf["digest"], "response": pd.Series(out, dtype=object)})

        open_.mapInPandas(ask, _SCHEMA).where("response is not null").write.mode("append").parquet(f"{self.path}/answers")
        # All of these are in the table now.
        remove(spark, root)
        known = self.answers(spark).select(F.col("digest").alias(of), F.col("response").alias(response))
        return keyed.join(known, F.col(digest) == F.col(of), "left").drop(digest, of)
