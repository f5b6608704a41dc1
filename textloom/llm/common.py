"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder, deleted at its end; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def frozen(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut.

    Spark's cleaner deletes the files once nothing refers to them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Below so many rows shuffle files are too small to wait for their deletion.
RELEASE_ROWS = 10_000


def release(df: DataFrame, rows: int) -> None:
    """Lets Spark's cleaner delete shuffle and checkpoint files that nothing refers to any more, after steps on so many rows.

    References from Python, the plan and its shuffles go one after the other, a collection each.
    """
    if rows < RELEASE_ROWS:
        return
    for _ in range(6):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.4)


#: Files whose numbers are broadcast; those of more are joined as Spark sees fit.
BROADCAST_FILES = 200_000


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with `name`, a long of its own for each row, the same whenever docs is read.

    Rows of files have the file's number, by path, and theirs in the file: scans may be split in other ways when
    executors come or go, which the place in a partition depends on. Other rows are kept in the shared folder.
    """
    try:
        paths = docs.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:  # not rows of files
        return frozen(docs.withColumn(name, F.monotonically_increasing_id()))
    files = sorted(r["__path"] for r in paths.select("__path").distinct().collect())  # a row per file
    table = docs.sparkSession.createDataFrame(pa.table({"__path": pa.array(files, pa.string()), "__number": pa.array(range(len(files)), pa.int64())}))
    table = F.broadcast(table) if len(files) <= BROADCAST_FILES else table
    numbered = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__index")).join(table, "__path")
    return numbered.withColumn(name, F.shiftleft("__number", 40).bitwiseOR(F.col("__index"))).select(*(F.col(f"`{c}`") for c in docs.columns), name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written to path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def slots(rows: DataFrame, group: str, part: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, as long `out`.

    `part` splits a group into bounded parts (an input split or a hash bucket). Counts of parts are added up first,
    so a group of any size is numbered by many tasks; only the counts of one group's parts meet in a task.
    """
    g, p = f"__{group}", f"__{part}"
    before = Window.partitionBy(g).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(group).alias(g), F.col(part).alias(p)).agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy(group, part).orderBy(*order))
    numbered = rows.withColumn("__local", local)
    joined = numbered.join(starts, (F.col(group) == F.col(g)) & (F.col(part) == F.col(p)))
    return joined.withColumn(out, (F.col("__from") + F.col("__local") - 1).cast("long")).drop(g, p, "__from", "__local")


def text_batches(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in parts of about `most` bytes of the column text, a row at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist() if b.num_rows else []
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if b.num_rows:
            yield b.slice(start)
