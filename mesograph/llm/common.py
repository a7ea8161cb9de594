"""What several operators share: stored work tables, files in the shared folder, and row helpers."""

from __future__ import annotations

import sys
import types

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, work: list[str] | None = None) -> DataFrame:
    """The rows of `df` written to a Parquet table in the shared folder and read from there; cuts the lineage.

    `work` collects the paths of tables that no later result reads, for `discard`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if work is not None:
        work.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python in batches of at most so many rows, which bounds the memory on both sides of the pipe.

    For queries and pipelines over long texts; operators leave the session as it is.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting, "10000")) > rows:
        spark.conf.set(setting, str(rows))


def discard(work: list[str]) -> None:
    """Delete the work tables at these paths."""
    for uri in work:
        files, path = filesystem(uri)
        files.delete_dir(path)
    work.clear()


def filesystem(uri: str):
    """The file system of a shared path, usable in any task, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TaskFile:
    """A file of one task: written under a name of the attempt, renamed when it is whole, so a lost or repeated attempt leaves no half file."""

    def __init__(self, folder: str, suffix: str):
        context = TaskContext.get()
        self.part = context.partitionId()
        self.name = f"part-{self.part:06d}{suffix}"
        self.files, base = filesystem(folder)
        self.files.create_dir(base, recursive=True)
        self.temporary = f"{base}/_attempt-{context.taskAttemptId()}{suffix}"
        self.final = f"{base}/{self.name}"
        self.out = self.files.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.out.close()
        self.files.move(self.temporary, self.final)
        return self.name


def process_state(owner: str) -> dict:
    """A dictionary that lives as long as this Python worker, across the tasks it runs; another owner finds it empty."""
    state = sys.modules.setdefault("_mesograph_process_state", types.ModuleType("_mesograph_process_state")).__dict__
    if state.get("owner") != owner:
        state.clear()
        state["owner"] = owner
    return state


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else: the fast `lower` where no other character has a lower case."""
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def id_remainder(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def spread_out(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Deal rows out evenly where the input has fewer splits than there are cores."""
    width = spark.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def own_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names close to the wanted ones that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names
