"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import math
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import freeing, shared_dir  # noqa: F401

#: White space of the word contracts: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A writer holds a row group in memory, and each task has one.
ROW_GROUP_BYTES = 32 << 20


#: Rows that go to a Python worker at once. Both ends of the pipe hold a batch of whole texts, and so does the function.
BATCH_ROWS = 1000
#: What an operator keeps in a worker from task to task, as functions that drop it.
KEPT: list[Callable[[], None]] = []


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, and sees to it that the session sends them batches of BATCH_ROWS rows at most."""
    session.ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: what is read again was computed once and survives lost executors.

    A table in the shared folder, as a checkpoint would keep the size that was estimated for its plan: over rounds of
    joins such estimates multiply until planning takes longer than the work. A table has the size of its files.
    """
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in _MAKING:
        made.add(path)
    with freeing(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with its rows numbered in a column ``name``: stored, so that all who read it see the same numbers."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def folders(df: DataFrame) -> set[str]:
    """The folders whose files df reads."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by stored(), once all that was read from it is cut or written."""
    delete(df.sparkSession, folders(df))


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    context = spark.sparkContext
    for folder in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    reclaim(spark)


def reclaim(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nobody holds any longer. Executors keep them until the driver's collector
    finds those plans, which it does late, as the driver itself needs little memory."""
    spark.sparkContext._jvm.System.gc()


#: The sets in which stored() notes its paths at present.
_MAKING: list[set[str]] = []


@contextmanager
def making(paths: set[str]) -> Iterator[None]:
    """Notes in paths the tables that stored() makes meanwhile."""
    _MAKING.append(paths)
    try:
        yield
    finally:
        _MAKING.remove(paths)


OFTEN_KEYS = 10_000
LEAST_OFTEN = 200
PLAIN_ROWS = 20_000


def often(left: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys that left has often, at most OFTEN_KEYS of them whatever the data, and to how many salts each is dealt;
    None where left has no more than PLAIN_ROWS rows, which are no burden for one task. left should be cut."""
    n = left.count()
    if n <= PLAIN_ROWS:
        return None
    most = max(LEAST_OFTEN, math.ceil(n / OFTEN_KEYS))
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return cut(counts.select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts")))


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left.join(right, keys, how), where right has each key once at most and left may have one in a third of its rows.

    Rows of keys that left has often are dealt to several salts and right's row is repeated for each, so no key stays in
    one task. hot: what often() gave for these keys; without it left is counted here. how: inner or left.
    """
    hot = often(left, keys) if hot is None else hot
    if hot is None:
        return left.join(right, keys, how)
    hot, one = F.broadcast(hot), F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), one).cast("int")).drop("_salts")
    each = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return dealt.join(each, [*keys, "_salt"], how).drop("_salt")


def release(keep: bool = False) -> None:
    """Gives back the memory that a Python worker holds no longer, as workers outlive their tasks and go from operator to
    operator; what others left there goes as well unless keep."""
    for drop in [] if keep else KEPT:
        drop()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def tidy(run, keep: bool = False):
    """A function for mapInArrow that gives memory back at the end of its task. keep: see release()."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release(keep)

    return tidied


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, gaps: str = SPACE) -> Column:
    """The runs of characters outside the class ``gaps``; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{gaps}+"), lambda w: w != "")


def index_range(n: Column) -> Column:
    """0 to n - 1; empty for n below 1 (sequence(0, -1) would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def with_columns_like(kept: DataFrame, like: DataFrame) -> DataFrame:
    return kept.select(*[kept[f"`{c}`"] for c in like.columns])

