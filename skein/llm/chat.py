"""Chat formatting: cumulative snapshots are collapsed before rendering, in DataFrame functions only.

A log often holds a conversation again and again, each time with a few more turns. A rolling hash of the turns so far
stands for each prefix; a conversation whose whole hash is a proper prefix of another's goes (anti-join), and of equal
conversations the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: The marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(chats: DataFrame) -> DataFrame:
    """The turns in order, numbered from 1. Ties of a turn number go by role, then text; null texts are empty."""
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return rows.withColumn("i", F.row_number().over(order).cast("long"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, i, n, hash): 128 bits for the first i turns: a running sum of hashes that depend on the turn's place."""
    line = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    part = [F.sum(F.xxhash64(F.lit(seed), "i", "role", "text").cast("decimal(38,0)")).over(line).cast("string") for seed in (3, 5)]
    return turns.select("conv_id", "i", F.count("*").over(Window.partitionBy("conv_id")).alias("n"), F.concat_ws("/", *part).alias("hash"))


def maximal(chats: DataFrame) -> DataFrame:
    """(conv_id, n): the conversations that stay. Rows without conv_id are one conversation, as in a grouping."""
    rows = cut(prefixes(_turns(chats)))
    # Equal conversations are one row, and so are equal prefixes, before they meet: no key is hot.
    whole = rows.where("i = n").groupBy("n", "hash").agg(F.min("conv_id").alias("conv_id"))
    longer = rows.where("i < n").select(F.col("i").alias("n"), "hash").distinct()
    return whole.join(longer, ["n", "hash"], "left_anti").select("conv_id", "n")


def rendered(chats: DataFrame) -> DataFrame:
    """One row per conversation that stays: conv_id, n_turns, text. Marks within texts are broken up, so that no text
    can open or close a turn. An empty table gives an empty result."""
    safe = F.replace(F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    lines = _turns(chats).select("conv_id", "i", F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), safe, F.lit(f"{CLOSE}\n")).alias("line"))
    kept = maximal(chats)
    stays = lines.alias("t").join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")), "left_semi")
    whole = stays.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"))
    return whole.select("conv_id", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce("text", '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce("text", '')) AS i
  FROM conversations
), c AS (
  SELECT conv_id, list({'role': role, 'body': body} ORDER BY i) AS turns, count(*) AS n FROM t GROUP BY conv_id
), p AS (
  SELECT DISTINCT k.k AS k, turns[1:k.k] AS head FROM c, LATERAL (SELECT unnest(range(1, n)) AS k) k
), m AS (
  SELECT min(conv_id) AS conv_id, turns, n FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = c.n AND p.head = c.turns) GROUP BY turns, n
)
SELECT m.conv_id AS conv_id, CAST(m.n AS BIGINT) AS n_turns,
       string_agg('<|im_start|>' || t.role || chr(10) || replace(replace(t.body, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10), '' ORDER BY t.i) AS "text"
FROM m JOIN t ON t.conv_id = m.conv_id GROUP BY m.conv_id, m.n
"""
