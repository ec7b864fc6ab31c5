"""A table of one row per key that batches update in part: hash buckets, of which only the touched ones are written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketState:
    """Rows by key in buckets. A batch writes its buckets into a folder of its own, and then, as its commit, a list of the
    folder in which each bucket lies. A batch that is stopped leaves no list and is run again from the state before it; one
    that is run again after its commit changes nothing. Folders of older lists are kept for KEEP batches, for readers.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[int]:
        where = self._path(folder)
        if not self._system().exists(where):
            return []
        return sorted(int(s.getPath().getName().partition(".")[0]) for s in self._system().listStatus(where) if s.getPath().getName().endswith((".json", ".data")))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commit(self) -> tuple[int, dict[int, int]]:
        """The newest batch, and in whose folder each bucket lies; -1 and nothing at first."""
        done = self._names("commits")
        if not done:
            return -1, {}
        text = self.spark.read.text(f"{self.path}/commits/{done[-1]}.json").first()[0]
        return done[-1], {int(k): v for k, v in json.loads(text).items()}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        _, lies = self.commit()
        paths = [f"{self.path}/batches/{v}.data/bucket={b}" for b, v in lies.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, batch_id: int, merge) -> None:
        """merge(old, rows): the new rows of the buckets that the batch touches."""
        newest, lies = self.commit()
        if batch_id <= newest:
            return
        rows = batch.where(F.col(self.key).isNotNull()).select(*self.schema.names)
        touched = [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]
        merged = merge(self.read(touched), rows).select(*self.schema.names).withColumn("bucket", self.bucket())
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batches/{batch_id}.data")
        self._write(f"commits/{batch_id}.json", json.dumps(lies | {b: batch_id for b in touched}))
        self._clear()

    def _write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        draft = self._path(f"{name}.draft")
        out = self._system().create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._system().rename(draft, self._path(name))

    def _clear(self) -> None:
        """Deletes folders that no list of the last KEEP names, and older lists."""
        done = self._names("commits")
        used = set()
        for k in done[-self.KEEP :]:
            used |= set(json.loads(self.spark.read.text(f"{self.path}/commits/{k}.json").first()[0]).values())
        for k in set(self._names("batches")) - used:
            if k <= done[-1]:
                self._system().delete(self._path(f"batches/{k}.data"), True)
        for k in done[: -self.KEEP]:
            self._system().delete(self._path(f"commits/{k}.json"), True)
