"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: the sources share all words by weight, stop at a multiple of their own size, and the excess is reshared. The
mix is made of blocks of equally many words. Highest quotients target / (2k + 1) give each source an integer number of
blocks; the same rule gives each of a source's shards its quota; and within a shard a seeded permutation of its blocks
says which are taken once more than the others. A shard is a bounded part of a source, so a hot source is many shards;
where they are more than WARD_SHARDS, wards of so many shards get their quotas first, by the same rule, so no apportionment
ranks more than a bounded number of shards at once. The few rows of sources and wards are ranked in one window each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, index_range, numbered, table

BLOCK_WORDS = 8
SHARD_ROWS = 256
WARD_SHARDS = 4096
#: A prime above the number of blocks of a shard, so that multiplying by it permutes them.
PRIME = 2147483647


def n_words(text: Column) -> Column:
    """Runs of characters other than space and 9 to 13; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sources: (source, source_size). Adds weight and target: min(most * size, level * weight), the level such that
    the targets sum to the total. Weights go by code point order of the sources, null last, and repeat."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most))
    # Sources in the order in which a rising level fills them; a source is full if the level at its own turn reaches it.
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    rows = rows.withColumn("open", F.col("level") * F.col("weight") < F.col("full"))
    level = F.max(F.when(F.col("open"), F.struct((-F.col("full") / F.col("weight")).alias("k"), F.col("level").alias("v")))).over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("target", F.when(F.col("open"), level["v"] * F.col("weight")).otherwise(F.col("full"))).drop("level", "open", "full", "total")


def sainte_lague(rows: DataFrame, group: list[str], key: list[str], claim: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each row's group go to the highest quotients claim / (2k + 1), ties by key.

    Only quotients that can lie at the cut are formed: a group of s rows moves a row's quota from claim's exact share q
    by less than q * s / (2 * seats) + 2, so their number is linear in s, whatever the number of seats.
    """
    g = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    x = rows.withColumn("_sum", F.sum(claim).over(g)).withColumn("_s", F.count("*").over(g))
    x = x.withColumn("_q", F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum") * F.col(seats)).otherwise(F.lit(0.0)))
    x = x.withColumn("_w", F.when(F.col(seats) > 0, F.ceil(F.col("_q") * F.col("_s") / (2 * F.col(seats))) + 2).otherwise(F.lit(0)))
    x = x.withColumn("_base", F.greatest(F.lit(0), F.floor("_q") - F.col("_w")).cast("long"))
    x = x.withColumn("_open", F.when(F.col("_sum") > 0, F.col(seats) - F.sum("_base").over(g)).otherwise(F.lit(0)))
    tries = x.withColumn("_k", F.explode_outer(F.sequence(F.col("_base"), (F.col("_base") + 2 * F.col("_w") + 1).cast("long"))))
    best = g.orderBy((F.col(claim) / (2 * F.col("_k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in key], "_k")
    won = tries.withColumn("_won", ((F.row_number().over(best) <= F.col("_open")) & (F.col(claim) > 0)).cast("long"))
    keep = [c for c in rows.columns]
    return won.groupBy(*keep).agg((F.first("_base") + F.sum("_won")).alias("quota"))


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    seed: int = 7,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    ward_shards: int = WARD_SHARDS,
) -> DataFrame:
    """Per row of docs: doc_id, row, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Null texts have no words; a null source is a source of its own, last in order; rows that repeat are taken each for
    itself; an empty table gives an empty result. Nothing is taken more than ``most`` times, a whole number.
    """
    if most != int(most):
        raise ValueError("most: a block is taken a whole number of times")
    sizes = numbered(docs.select("doc_id", F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "row")
    return _mix(sizes, weights, most, seed, block_words, shard_rows, ward_shards)


def _mix(sizes: DataFrame, weights: Sequence[float], most: float, seed: int, block_words: int, shard_rows: int, ward_shards: int) -> DataFrame:
    """sizes: (row, doc_id, source, size), stored."""
    sources = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("blocks", F.round(total / block_words).cast("long"))
    sources = cut(
        sainte_lague(sources, [], ["source"], "target", "blocks")
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_rows)).cast("long"))
        .select("source", "source_size", "target", "quota", "shards")
    )
    # Sources are few beside rows, but their number has no bound: an ordinary join, which Spark may turn to a broadcast.
    # A salt that both sides share keeps a hot source out of a single task.
    salts = 64
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = sizes.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(salts)).cast("int")).alias("d")
    rows = rows.join(salted.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.salt") == F.col("s.salt"))).select("d.row", "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.shards")
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("shard", F.pmod(F.col("deal"), F.col("shards"))).drop("shards")
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).withColumn("ward", F.expr(f"shard div {ward_shards}"))
    shards = cut(shards)
    wards = shards.groupBy("source", "ward").agg(F.sum("shard_size").alias("ward_size"))
    wards = wards.alias("h").join(sources.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.source", "h.ward", "h.ward_size", F.col("s.quota").alias("seats"))
    wards = cut(sainte_lague(wards, ["source"], ["ward"], "ward_size", "seats"))
    same_ward = F.col("h.source").eqNullSafe(F.col("w.source")) & (F.col("h.ward") == F.col("w.ward"))
    shards = shards.alias("h").join(wards.alias("w"), same_ward).select("h.source", "h.ward", "h.shard", "h.shard_size", F.col("w.quota").alias("seats"))
    shards = sainte_lague(shards, ["source", "ward"], ["shard"], "shard_size", "seats").drop("seats", "ward")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("deal"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    both = placed.alias("p").join(shards.alias("h"), F.col("p.source").eqNullSafe(F.col("h.source")) & (F.col("p.shard") == F.col("h.shard"))).select("p.*", "h.shard_size", "h.quota")
    n = F.ceil(F.col("shard_size") / block_words)
    both = both.withColumn("n", n).withColumn("times", F.when(F.col("n") > 0, F.least(F.expr("quota div n"), F.lit(int(most)))).otherwise(F.lit(0)))
    both = both.withColumn("more", F.when((F.col("n") > 0) & (F.col("times") < int(most)), F.col("quota") - F.col("times") * F.col("n")).otherwise(F.lit(0)))
    both = both.withColumn("turn", F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), F.greatest(F.col("n"), F.lit(1))))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")

    def chosen(b: Column) -> Column:
        return F.pmod(b * PRIME + F.col("turn"), F.col("n")) < F.col("more")

    def overlap(b: Column) -> Column:
        return F.least((b + 1) * block_words, F.col("start") + F.col("size")) - F.greatest(b * block_words, F.col("start"))

    some = F.when(
        (F.col("size") > 0) & (F.col("more") > 0),
        F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, b: a + F.when(chosen(b), overlap(b)).otherwise(F.lit(0).cast("long"))),
    ).otherwise(F.lit(0).cast("long"))
    return both.withColumn("taken", (F.col("times") * F.col("size") + some).cast("long")).select("row", "doc_id", "source", "size", "source_size", "target", "taken", "shard")


def mixed_documents(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as the mix takes it: taken / size, rounded by a
    draw that the seed, the id and the size decide, whatever the files.

    Documents without words (null or empty texts) cannot be weighed and stay once. A null source is a source of its own;
    rows that repeat are taken each for itself; an empty table gives an empty result.
    """
    packed = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")), "row")
    sizes = cut(packed.select("row", "_all.doc_id", F.col(f"_all.`{source_col}`").alias("source"), n_words(F.col(f"_all.`{text_col}`")).alias("size")))
    quota = _mix(sizes, weights, most, seed, BLOCK_WORDS, SHARD_ROWS, WARD_SHARDS).select("row", "doc_id", "size", "taken")
    draw = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 4)), F.lit(1000003)) / 1000003.0
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(F.lit(1)).cast("int")
    chosen = quota.select("row", copies.alias("_copies")).where("_copies > 0")
    again = packed.join(chosen, "row").withColumn("_again", F.explode(index_range(F.col("_copies"))))
    return again.select(*[F.col(f"_all.`{c}`").alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")
