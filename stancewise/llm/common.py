"""What the operators of this subpackage share: written intermediate tables, batches for Python tasks, id rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows from which a group is hot, and hot groups (some 100 bytes each) that are broadcast at most.
HOT, BROADCAST_HOT = 500, 200_000

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a new temporary one in local mode, else an error: executors
    do not share a machine's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder.setdefault("path", tempfile.mkdtemp(prefix="stancewise-"))


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes df once as Parquet in the shared folder (a folder per value of ``by``) and returns the reader.

    Cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and gives every later use
    the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stancewise/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Spark drops shuffle files and broadcast blocks of finished jobs, here and on the executors,
    only as the driver's references to them are collected; between the passes of an operator of many jobs that should not wait until
    the driver's heap is full."""
    spark.sparkContext._jvm.System.gc()


def batches_of(spark: SparkSession, rows: int) -> None:
    """Bounds the Arrow batches of the Python tasks that follow, in rows and (where Spark knows it) in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def id_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0))


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; else unhinted, for Spark's shuffle joins."""
    return F.broadcast(df) if rows <= most else df


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal; the key columns of left stay."""
    names = {c: fresh(left, f"right_{c}") for c in on}
    same = F.lit(True)
    for c, name in names.items():
        right = right.withColumnRenamed(c, name)
        same = same & F.col(c).eqNullSafe(F.col(name))
    return left.join(right, same, how).drop(*names.values())


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def words_print(text: Column) -> Column:
    """16 bytes (of a SHA-256) that tell texts apart by their words in order; white space only separates words."""
    return F.unhex(F.substring(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")).cast("binary"), 256), 1, 32))


def handed_back(rows: DataFrame, groups: DataFrame, on: str, size: str) -> DataFrame:
    """rows with the columns of their group (one row per value of ``on``; ``size`` counts its rows). Both are written tables.

    Groups of HOT and more rows, of which there are at most rows / HOT, are broadcast, so that a group with a third of all rows
    stays where its rows are; the rest meet by shuffle.
    """
    hot = groups.filter(F.col(size) >= HOT)
    n = hot.count()
    if not n:
        return rows.join(groups, on)
    near = broadcast_if(hot, n, BROADCAST_HOT)
    rest = rows.join(broadcast_if(hot.select(on), n, BROADCAST_HOT), on, "left_anti")
    return rows.join(near, on).unionByName(rest.join(groups.filter(F.col(size) < HOT), on))


def without_copies(docs: DataFrame, found: DataFrame, mark: Column, most: int) -> DataFrame:
    """The rows of docs but those that found (doc_id, mark, kept, n rows of it) lists as gone; of n rows with a listed id and
    mark one stays if kept. Rows are told apart by id and mark, so rows with null or repeated ids keep their own fate. Columns of docs."""
    name = fresh(docs, "mark")
    marked = docs.withColumn(name, mark)

    def joined(keys: DataFrame, how: str) -> DataFrame:
        near = broadcast_if(keys.select("doc_id", F.col("mark").alias(name)), keys.count(), most)
        return null_safe_join(marked, near, ["doc_id", name], how)

    once = joined(found, "left_anti")
    again = joined(found.filter("kept"), "left_semi").dropDuplicates(["doc_id", name])
    return once.unionByName(again).drop(name)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker gives the memory that its task freed back to the system: workers live on."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return lean_run
