"""Session settings, the folder that executors share, and the package for workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session with what the operators rest on: UTC, adaptive execution, ANSI mode."""
    builder = SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    builder = builder.master(master) if master else builder
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where that is unset (tests), a temporary one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().get()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of what is run meanwhile as soon as it has ended, not when the driver's collector
    finds its plan: a table that is written has no more need of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


CODEC = "zstd"  # of stored tables: a flight's id is hexadecimal text, which Spark's default codec leaves at its length


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for plans that read it many times. Its shuffle files go when it is written."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the stored table that df reads, when nothing needs it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that a table was written into."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once an application, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
