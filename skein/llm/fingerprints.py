"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the top bits choose one of 128 bins and the smallest hash of a bin stays. An
empty bin takes the value of the first bin with one in an order of its own, drawn by a hash of both numbers (optimal
densification: of the filled bins each is as likely to come first, independently for each empty bin). Of each value the low 8 bits are stored, 8 to a
64-bit word. The likeness of two fingerprints is the share of equal bytes, less what chance gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, index_range, let, table, words

SHINGLE_WORDS = 5
BIN_BITS, VALUE_BITS = 7, 8
BINS = 1 << BIN_BITS
WORDS = BINS * VALUE_BITS // 64


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of five words (A-Z lower-cased); of fewer words the whole sequence; of none an empty array."""
    return let(
        words(ascii_lower(text)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < SHINGLE_WORDS, F.array(F.xxhash64(w)))
        .otherwise(F.transform(index_range(F.size(w) - (SHINGLE_WORDS - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE_WORDS)]))),
    )


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def _smallest(hashes: Column) -> Column:
    """The smallest hash of each bin that has any: after sorting, the first of each run of one bin."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))


def fingerprint(text: Column) -> Column:
    """array<bigint> of the packed bins. A text without words has the fingerprint of zeros; null counts as empty."""
    low = F.lit((1 << VALUE_BITS) - 1).cast("long")

    def dense(held: Column) -> Column:
        def borrowed(i: Column) -> Column:
            turn = lambda h: F.xxhash64(_bin(h) * BINS + i)
            return F.array_min(F.transform(held, lambda h: F.shiftleft(turn(h), VALUE_BITS).bitwiseOR(h.bitwiseAND(low)))).bitwiseAND(low)

        return let(
            F.transform(held, lambda h: _bin(h).cast("int")),
            lambda bins: F.transform(
                index_range(F.lit(BINS)),
                lambda i: let(F.array_position(bins, i).cast("int"), lambda p: F.when(p > 0, F.get(held, p - 1).bitwiseAND(low)).otherwise(borrowed(i))),
            ),
        )

    per = 64 // VALUE_BITS
    packed = let(
        let(_smallest(shingle_hashes(text)), lambda held: F.when(F.size(held) == 0, F.array_repeat(F.lit(0).cast("long"), BINS)).otherwise(dense(held))),
        lambda v: F.transform(index_range(F.lit(WORDS)), lambda j: F.aggregate(F.slice(v, j * per + 1, per), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, VALUE_BITS).bitwiseOR(x))),
    )
    return packed


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1: (equal bytes - chance) / (1 - chance)."""
    nibbles, ones = F.lit(0x0F0F0F0F0F0F0F0F), F.lit(0x0101010101010101)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 4)).bitwiseAND(nibbles)
        return let(z, lambda q: F.bit_count(let(q.bitwiseOR(F.shiftrightunsigned(q, 2)), lambda r: r.bitwiseOR(F.shiftrightunsigned(r, 1))).bitwiseAND(ones)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << VALUE_BITS)
    return F.greatest(F.lit(0.0), ((BINS - unequal) / BINS - chance) / (1 - chance))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids: distinct, not null doc_id (other columns stay). Adds next_id: the next smaller id; the largest after the last.

    Ids are sorted by range; within a range the next row is looked up, and between ranges only their first ids are.
    """
    ranged = cut(ids.repartitionByRange(F.col("doc_id").desc()).withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("head").desc())  # a row for each partition
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.max("head").over(Window.partitionBy(F.lit(0)))).alias("then"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.col("doc_id").desc()))
    return ranged.withColumn("_inside", inside).join(heads, "part").withColumn("next_id", F.coalesce("_inside", "then")).drop("part", "_inside", "then")


def with_edited(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts (see op6 in the README).

    Null texts are empty. Rows that repeat an id each have the next smaller id as their next document; of the texts
    that this id has, the greatest counts. Rows with a null id have no next document: their tail is cut off and
    near_next is 0. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    # One shuffle of the texts by id serves both sides of the join below.
    base = rows.where("doc_id IS NOT NULL").withColumn("print", fingerprint(F.col("text"))).repartition("doc_id")
    links = next_ids(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(third).alias("need")))
    heads = base.alias("e").join(links.alias("l"), F.col("e.doc_id") == F.col("l.next_id")).select(F.col("l.doc_id").alias("to"), F.struct(F.substring(F.col("e.text"), F.lit(1), F.col("l.need")).alias("head"), F.col("e.print")).alias("n"))
    heads = heads.groupBy("to").agg(F.max("n").alias("n"))
    both = base.join(heads, F.col("doc_id") == F.col("to"), "left").select("doc_id", "text", "print", F.col("n.head").alias("head"), F.col("n.print").alias("next_print"))
    lone = rows.where("doc_id IS NULL").select("doc_id", "text", fingerprint(F.col("text")).alias("print"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<bigint>").alias("next_print"))
    both = both.unionByName(lone)
    n = F.length("text")
    cut_at = third
    edited = F.concat(F.substring("text", F.lit(1), n - cut_at), F.substring(F.coalesce("head", F.lit("")), F.lit(1), cut_at))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    both = both.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), F.coalesce(likeness(F.col("print"), F.col("next_print")), F.lit(0.0)).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(table(spark, sf_dir, "documents"))
