"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import ensure_checkpoint_dir

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_settling: list[list[str]] = []


@contextmanager
def settling() -> Iterator[list[str]]:
    """The paths that are settled while it lasts."""
    files: list[str] = []
    _settling.append(files)
    try:
        yield files
    finally:
        _settling.remove(files)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither repeat
    its work nor need an executor that may be lost."""
    path = shared_path(df.sparkSession, name)
    for files in _settling:
        files.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled ``df`` that nothing reads any more."""
    delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def delete(spark: SparkSession, paths) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs. Spark deletes them when the driver's garbage collection finds
    that nothing refers to them any more, which a driver with room to spare may not start for long."""
    spark._jvm.System.gc()


#: Bits of the table in which ids are marked: 8 MB, however many there are.
MARK_BITS = 26


def by_mark(rows: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is surely not among ``ids`` (id), rows whose id may be), all rows staying where they are.

    Ids are marked in a bit table of fixed size, which is sent to the rows; ids that share a bit with a
    marked one are among the second rows, which a join tells apart."""
    place = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << MARK_BITS) - 1)) + 1
    slots = ids.select(place(F.col("id")).alias("slot"))
    table = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bucket, bits = free_name(rows, "bucket"), free_name(rows, "bits")
    table = F.broadcast(settle(table, "marks").toDF(bucket, bits))  # at most 2^(MARK_BITS - 15) rows of 4 KB
    slot = place(F.col(id_col))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.col(bits).substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2
    marked = F.coalesce(bit, F.lit(0)) == 1
    joined = rows.join(table, F.bitmap_bucket_number(slot) == F.col(bucket), "left")
    return joined.where(~marked).select(*rows.columns), joined.where(marked).select(*rows.columns)


def whole_text(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def how_many(spans: str, kind: int) -> Column:
    """Number of spans of a kind. (A lambda with a second argument would be given the position.)"""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
