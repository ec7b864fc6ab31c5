"""Filter interaction audit: what each filter removes in every order in which the filters may stand.

Spark finds for each document which filters it fails and counts documents by part and pattern of failures; a part is then
a row with a tensor of 2 x 2 x ... counts, an axis (passes, fails) for each filter. Every figure of every order is a
contraction of that tensor: an axis is read at "pass" for filters that stand before, at "fail" or "pass" for the filter
itself and summed over for those that stand behind. All orders of a part are one einsum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, cut, let, many_to_one, ship, table, words

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: The last filter, over the table and not over a text: another row with a smaller id has the same text.
REPEATED = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_filters(text: Column) -> dict[str, Column]:
    """For each filter over a text alone: does the text fail it. A: under 50 words; B: under 65 % of them distinct;
    C: over 5 % of its code points in A to Z; D: holds one of # $ % & * |."""
    size = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"size": size, "A": F.col("size.n") < 50, "B": 100 * F.col("size.d") < 65 * F.col("size.n"), "C": 100 * upper > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, pattern (bit k: fails the k-th filter), good and toxic (of any of its labels).

    Null texts and sources count as empty. Equal texts are told by SHA-256 and length; a null doc_id comes after all others.
    Of a text, a third of all rows may hold copies, and of a doc_id as well: both joins deal such keys to salts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = text_filters(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("size", found.pop("size"))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(found.values())), F.lit(0))
    slim = cut(rows.select("doc_id", "part", bits.alias("bits"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.length("text").alias("chars")))
    first = slim.groupBy("sha", "chars").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.count("doc_id").alias("ids")).where("n > 1")
    joined = many_to_one(slim, cut(first), ["sha", "chars"], "left")
    repeated = F.coalesce(F.when(F.col("doc_id").isNull(), F.col("ids") > 0).otherwise(F.col("doc_id") > F.col("first")), F.lit(False))
    seen = cut(joined.select("doc_id", "part", (F.col("bits") + F.when(repeated, 1 << len(found)).otherwise(0)).alias("pattern")))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = many_to_one(seen, cut(marks), ["doc_id"], "left")
    return marked.select("doc_id", "part", "pattern", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def tensors(marked: DataFrame, filters: int) -> DataFrame:
    """One row per part: arrays of 2**filters counts of all, good and toxic documents, by pattern."""
    cells = marked.groupBy("part", "pattern").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    each = [F.array(*[F.coalesce(F.sum(F.when(F.col("pattern") == k, F.col(c))), F.lit(0)).cast("long") for k in range(1 << filters)]).alias(c) for c in ("n", "good", "toxic")]
    return cells.groupBy("part").agg(*each)


@cache
def plan(filters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step), and for each figure what is read along each axis: an array of rows x filters x 2."""
    rows = [("".join(order), step) for order in permutations(filters) for step in range(1, len(filters) + 1)]
    read: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order, step in rows:
        before, own = set(order[: step - 1]), order[step - 1]
        read["kept"].append([PASS if f in before or f == own else ALL for f in filters])
        read["removed"].append([PASS if f in before else FAIL if f == own else ALL for f in filters])
        read["failing"].append([FAIL if f == own else ALL for f in filters])
        read["unique_fails"].append([FAIL if f == own else PASS for f in filters])
    return rows, {k: np.array(v, dtype=np.int64) for k, v in read.items()}


def contracted(tensor: np.ndarray, read: np.ndarray) -> np.ndarray:
    """tensor, an axis of two for each filter, contracted as each row of read says."""
    axes = tensor.ndim
    z = axes  # the number that stands for the row of read
    operands = [x for k in range(axes) for x in (read[:, k, :], [z, k])]
    return np.einsum(tensor, list(range(axes)), *operands, [z])


def figures(n: list[int], good: list[int], toxic: list[int], filters: str) -> dict[str, np.ndarray]:
    """The counts of all orders and steps of one part."""
    rows, read = plan(filters)
    # Bit k of a pattern is the k-th filter, so the last axis of the reshaped array is the first filter's.
    whole, fine, bad = (np.array(x, dtype=np.int64).reshape((2,) * len(filters)).transpose() for x in (n, good, toxic))
    removed, own = contracted(whole, read["removed"]), np.array([filters.index(order[step - 1]) for order, step in rows])
    out = {"kept": contracted(whole, read["kept"]), "removed": removed, "redundant": contracted(whole, read["failing"]) - removed}
    out |= {"unique_fails": contracted(whole, read["unique_fails"]), "good_lost": contracted(fine, read["removed"]), "toxic_lost": contracted(bad, read["removed"])}
    return out | {"shapley": np.array([removed[own == f].sum() for f in range(len(filters))])[own]}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: documents kept, removed, redundantly failing, failing this filter only,
    good and toxic ones lost, and the filter's removals over all orders.

    docs: doc_id, text, source; labels: doc_id, quality, toxic (a document may have none, or several rows). Null texts and
    sources are empty, rows that repeat an id and text are no copies of each other, an empty table gives no rows; other
    columns are left aside.
    """
    ship(docs.sparkSession)
    filters = "ABCD" + REPEATED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _ = plan(filters)
        orders, steps = pa.array([o for o, _ in rows]), pa.array([s for _, s in rows], pa.int32())
        for batch in batches:
            for part, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                out = figures(*cells, filters)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), orders, steps, *[pa.array(out[c]) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    return tensors(patterns(docs, labels), len(filters)).mapInArrow(run, SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT d.doc_id, part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': d.doc_id > min(d.doc_id) OVER (PARTITION BY t)} AS x
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, x
), k AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k
), o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT o, unnest(range(1, 6)) AS step FROM o
), r AS (
  SELECT part, o, step, n, good, toxic,
         CASE o[step] WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END AS fails,
         x.A AND list_position(o, 'A') < step OR x.B AND list_position(o, 'B') < step OR x.C AND list_position(o, 'C') < step
           OR x.D AND list_position(o, 'D') < step OR x.E AND list_position(o, 'E') < step AS gone,
         CAST(x.A AS INT) + CAST(x.B AS INT) + CAST(x.C AS INT) + CAST(x.D AS INT) + CAST(x.E AS INT) AS failures
  FROM c, s
), g AS (
  SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INT) AS step, o[step] AS own,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND failures = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY part, o, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
