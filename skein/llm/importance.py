"""Target-distribution importance resampling: documents are drawn by how much likelier their features are under a target.

Texts are split once, by an untrained pre-tokenizer of the tokenizers library that gives words with their offsets; windows
over neighbouring offset pairs are the features. What is stored of a text is the list of its features' buckets, two bytes
each; the histograms of all documents and of the target, and then each document's sum of gains, are read from that. The
draw without replacement takes the highest sums of weight and a Gumbel variable that a hash of the id gives.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, discard, ship, table, tidy

#: What lies between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BUCKETS = 10_000
SLICE_CHARS = 1 << 18  # of a text, split at once: the library gives a list of all words
KNOWN_WORDS = 1 << 17  # kept by a task with their buckets, then forgotten


class Splitter:
    """Buckets of the features of a text: runs of least to most words, joined by one space."""

    def __init__(self, least: int, most: int, buckets: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(f"{GAPS}+"), behavior="removed").pre_tokenize_str
        self.gap, self.sizes, self.most, self.buckets = re.compile(GAPS), range(least, most + 1), most, buckets
        self.known: dict[str, int] = {}

    def bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found

    def slices(self, text: str) -> Iterator[tuple[int, int]]:
        """Ranges of about SLICE_CHARS that end in a gap, so no word is cut."""
        at = 0
        while at < len(text):
            gap = self.gap.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
            end = gap.end() if gap else len(text)
            yield at, end
            at = end

    def features(self, text: str) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of each feature. text has its ASCII letters in lower case."""
        n, out, tail = 0, [], ""
        for at, end in self.slices(text):
            part = tail + text[at:end]
            pairs = [offsets for _, offsets in self.split(part)]
            carried = min(n, self.most - 1)  # words of the slice before that stand in front of this one's
            n += len(pairs) - carried
            for size in self.sizes:
                first = max(0, carried - size + 1)  # windows wholly within the carried words were counted before
                if size == 1:
                    found = [self.bucket(part[a:b]) for a, b in pairs[first:]]
                else:
                    ends = range(first + size, len(pairs) + 1)
                    found = [self.bucket(" ".join(part[a:b] for a, b in pairs[e - size : e])) for e in ends]
                out.append(np.array(found, dtype=np.uint32))
            keep = pairs[-(self.most - 1) :] if self.most > 1 else []
            tail = " ".join(part[a:b] for a, b in keep) + " " if keep else ""
        return n, np.concatenate(out) if out else np.zeros(0, np.uint32)


def split_features(texts: DataFrame, id_col: Column, text_col: Column, least: int, most: int, buckets: int) -> DataFrame:
    """One row per text: id, n_words, n_features and features, the buckets as unsigned integers of 2 or 4 bytes."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(least, most, buckets)
        for batch in batches:
            sizes, counts, packed = [], [], []
            for text in batch.column(1):
                n, found = splitter.features(text.as_py())
                sizes.append(n)
                counts.append(len(found))
                packed.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["id", "n_words", "n_features", "features"])

    rows = texts.select(id_col.cast("long").alias("id"), ascii_lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    return rows.mapInArrow(tidy(run), "id long, n_words long, n_features long, features binary")


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in all rows: a task gives one row a bucket at most, and so does the whole."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column(0):
                counts += np.bincount(np.frombuffer(row.as_py(), kind), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket, in doubles."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets)))) for s, t in zip(corpus, target)], dtype=np.int64)


def gumbel(seed: str, doc_id: int | None) -> int:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of a hash of seed and id; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of gains over features) and score."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            weights = [int(gain[np.frombuffer(row.as_py(), kind)].sum()) for row in batch.column(3)]
            totals = [w + gumbel(seed, i) for w, i in zip(weights, ids)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(weights, pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (1, 2, ...) in the order of all. Rows are dealt by ranges of the order, numbered within their
    range, and each range begins where those before it end; no task holds more than its range."""
    spread = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows may stand in any order, and in several ranges
    ranged = cut(spread.repartitionByRange(*order, F.col("_row")).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, F.col("_row")))
    return ranged.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_row", "_in", "_start")


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: str = "2024", least_words: int = 20, percent: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, and rank, its place among the drawn ones (else null).

    docs: doc_id, text; target: text. Features are runs of least to most words. Of the N documents with at least
    least_words words, floor(percent N / 100) are drawn: the highest scores, ties to the smaller doc_id, null last. Null
    and empty texts have no features and weight 0; rows that repeat an id are drawn each for itself; with no or an empty
    target all gains come from smoothing alone; other columns are left aside. The histograms, of buckets rows, are the
    only data that the driver sees.
    """
    ship(docs.sparkSession)
    features = cut(split_features(docs, F.col("doc_id"), F.col("text"), least, most, buckets))
    wanted = split_features(target, F.lit(None), F.col("text"), least, most, buckets)
    gain = gains(histogram(features, buckets), histogram(wanted, buckets))
    rows = cut(scored(features, gain, seed))
    discard(features)
    open_ = rows.where(F.col("n_words") >= least_words)
    drawn = open_.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    taken = placed(open_, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return taken.select(*columns).unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
