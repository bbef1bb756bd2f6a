"""Cutting lineage after costly steps, so that what follows doesn't repeat them; names that no column has."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Where it is unset, a folder of our own, but only if the executors are threads of the driver: on a cluster each executor would
    write to its own disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="foliospark-")
        sc.setCheckpointDir(named)
    made = sc._jsc.sc().getCheckpointDir().get()
    remove_at_exit(spark, made)
    return named or made


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has the folder removed when the application ends: results can be read until then."""
    files, at = _path(spark, path)
    files.deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder until the application ends."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM forget plans that nothing refers to, upon which Spark removes their shuffle files from the executors' disks."""
    spark._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared folder that are removed together: ``with Scratch(spark) as s: df = s.keep(df)``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Removes a table that keep() returned."""
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(self.spark, file)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.root)


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """Each of names, lengthened until it is no column's name, in any case."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out
