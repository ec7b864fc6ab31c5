"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text without white space is cut into blocks of a fixed number of characters. Distinct blocks, sorted, get integer
names; then adjacent names are paired, the distinct pairs sorted and named in turn, until each document has one name.
Two documents are equal exactly when they need as many rounds and end with the same name: names stand for contents,
not for hashes of them. The order is that of a 64-bit hash, ties by content, and a name is the rank in it, so names
depend on the contents alone and not on partitions. As hashes are spread evenly, the order is found in even ranges.

The block texts are shuffled once, where they are named. The documents find their names by a 64-bit hash of the block;
blocks whose hash belongs to more than one text (checked, not assumed) are joined by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, many_to_one, numbered, stored, table

BLOCK_CHARS = 2048
RANGE_BITS = 12  # hash ranges that are sorted each for itself


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def blocks(text: Column, size: int) -> Column:
    """Blocks of ``size`` code points, the last one shorter; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``name``, the rank of each of the distinct keys in the order of (h, keys)."""
    rows = cut(distinct.withColumn("_range", F.shiftright("h", 64 - RANGE_BITS)))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy("h", *keys))
    return rows.join(F.broadcast(offsets), "_range").withColumn("name", F.col("_before") + place - 1).drop("_range", "_before")


def name_texts(docs: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """docs: a stored table whose column ``row`` numbers its rows. Gives (row, doc_id, n_chars, text_sha256, n_blocks, name).

    Rows have equal normalised texts exactly when (n_blocks, name) agree. Null texts count as empty. Other columns of
    docs are not read.
    """
    source = docs.select("row", "doc_id", F.col(text_col).alias("_text"))
    thin = stored(
        source.withColumn("_norm", normalised(F.col("_text"))).select(
            "row",
            "doc_id",
            F.length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_chars"),
            F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"),
            F.transform(blocks(F.col("_norm"), block_chars), lambda b: block_hash(b)).alias("hashes"),
        ),
        "thin",
    )
    block = source.select(F.explode(blocks(normalised(F.col("_text")), block_chars)).alias("block")).withColumn("h", block_hash(F.col("block")))
    names = cut(_named(block.select("h", "block").distinct().groupBy("h").agg(F.count("*").alias("n")), []))
    level = many_to_one(thin.select("row", F.posexplode("hashes").alias("pos", "h")), names, ["h"])
    shared = names.where("n > 1").select("h")
    if not shared.isEmpty():
        level = _told_apart(source, level, shared, block_chars, block_hash)
    sizes = thin.withColumn("n_blocks", F.size("hashes")).drop("hashes")
    rest = cut(level.select("row", "pos", "name").join(sizes.select("row", "n_blocks"), "row"))
    longest = sizes.agg(F.max("n_blocks")).first()[0] or 1
    done, rest, width = rest.where("n_blocks = 1").select("row", "name"), rest.where("n_blocks > 1"), 1
    while width < longest:  # as many rounds as the longest document has doublings
        pairs = rest.groupBy("row", "n_blocks", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = cut(pairs)
        distinct = pairs.select("left", "right").distinct().withColumn("h", F.xxhash64("left", "right"))
        width *= 2
        rest = cut(many_to_one(pairs, cut(_named(distinct, ["left", "right"])), ["left", "right"]).select("row", "n_blocks", "pos", "name"))
        done = done.unionByName(rest.where(F.col("n_blocks") <= width).select("row", "name"))
        rest = rest.where(F.col("n_blocks") > width)
    return sizes.join(done, "row")


def _told_apart(source: DataFrame, level: DataFrame, shared: DataFrame, size: int, block_hash) -> DataFrame:
    """Names for the blocks whose hash stands for several texts: those texts alone are read again and joined."""
    rows = source.select("row", F.posexplode(blocks(normalised(F.col("_text")), size)).alias("pos", "block"))
    rows = stored(rows.withColumn("h", block_hash(F.col("block"))).join(shared, "h", "left_semi"), "shared")
    own = cut(_named(rows.select("h", "block").distinct(), ["block"]).drop("h"))
    fixed = many_to_one(rows, own, ["block"]).select("row", "pos", (-2 - F.col("name")).alias("name"))
    return level.where("n = 1").select("row", "pos", "name").unionByName(fixed)


def exact_groups(docs: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and row).

    Of rows with equal normalised texts the one with the most characters in the original text stays, then the smallest
    doc_id (null last), then, among repeated rows, the first. An empty table gives an empty result.
    """
    return _groups(numbered(docs.select("doc_id", text_col), "row"), text_col, block_chars, block_hash)


def _groups(docs: DataFrame, text_col: str, block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    named = cut(name_texts(docs, text_col, block_chars, block_hash))
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    groups = named.groupBy("n_blocks", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("n_blocks", "name", "group_size", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_row"))
    return many_to_one(named, cut(groups), ["n_blocks", "name"]).select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names. Rows are numbered once, in a stored copy."""
    packed = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")), "row")
    kept = _groups(packed.select("row", "_all.doc_id", F.col(f"_all.`{text_col}`").alias("text")), "text").where("kept").select("row")
    return packed.join(kept, "row", "left_semi").select(*[F.col(f"_all.`{c}`").alias(c) for c in docs.columns])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
