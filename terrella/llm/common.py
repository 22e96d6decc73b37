"""What several corpus operators share: word patterns, digests and tables in the cluster's shared folder."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard as discard
from ..functions.storage import rows as rows_of
from ..functions.storage import settled as written
from ..functions.storage import shared_path as shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters and digits (after lower-casing) and of anything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: A side may be broadcast while it is known to hold no more bytes than this.
BROADCAST_BYTES = 16 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; `lower` does the same, faster, where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The lower-cased words of a text, an empty array for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shrink_heaps(spark: SparkSession) -> None:
    """Executors collect their garbage and give back the heap that they need no more, as far as a task reaches each of them.

    A heap that an earlier step filled else stays in memory, beside the Python workers and what the next step takes.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which else stay until the driver happens to collect garbage.

    Executors on their own, if there are any, shrink their heaps too.
    """
    gc.collect()
    spark._jvm.System.gc()
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        shrink_heaps(spark)


@contextmanager
def _setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1_000):
    """Within it, jobs hand Python workers so many rows at a time, which bounds their memory where texts are long."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def small_methods(spark: SparkSession):
    """Within it, jobs run without whole-stage code: a join's condition is a class of its own, cut into small methods.

    Within a join's loop, a long condition takes the JVM's compiler seconds and hundreds of MB beside the heap, which
    it gives back late or, where they are fragments, not at all.
    """
    return _setting(spark, "spark.sql.codegen.wholeStage", "false")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows, of row_bytes at most each, prove it small, else as it is."""
    return F.broadcast(df) if rows_of(df) * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, one for each name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
