"""Best-fit packing with certified bounds.

Texts are tokenised once; from then on only thin rows (id, piece, length, checksum) move. Pieces of full length are
sequences by themselves. The others are dealt to partitions, packed there by best-fit decreasing, and each partition's
number of sequences is held against lower bounds from dual-feasible functions. A partition that meets its bound is
certified and done; from the others, the documents of sequences that are not full go to a pool, are dealt anew in fewer
partitions, mixed with those of other partitions, and packed again, until an exchange saves nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, stored, table, tidy

CAPACITY = 2048
GROUP_PIECES = 4096
END_ID = 0


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids begin: all are ``capacity`` long but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, text_col: str, path: str | None, capacity: int) -> DataFrame:
    """Per piece: row, doc_id, piece, start, length, ids_crc32. A null text is empty: its only id is the end's."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        code = encoder(path or tokenizer_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts = code.encode(["" if t is None else t for t in part.column(2).to_pylist()])
                out, end = [], 0
                for row, doc, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[end : end + n], END_ID).astype("<u4")
                    end += n
                    begins = piece_starts(len(own), capacity)
                    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(own)], strict=True)):
                        out.append((row, doc, k, a, b - a, zlib.crc32(own[a:b].tobytes())))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(tidy(cut_up, keep=True), PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual-feasible functions give: total length; for each threshold t, pieces longer
    than capacity - t count whole, those of at least t their length, smaller ones nothing; and, for k = 2 to 12, lengths
    rounded by the k-fold step function."""
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    counts = np.bincount(x, minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    above = np.cumsum(counts[::-1])[::-1]  # pieces of at least this length
    mass = np.cumsum((counts * sizes)[::-1])[::-1]
    t = np.arange(1, capacity // 2 + 1)
    whole = above[np.minimum(capacity - t + 1, capacity)] * (capacity - t + 1 <= capacity)
    middle = mass[t] - np.where(capacity - t + 1 <= capacity, mass[np.minimum(capacity - t + 1, capacity)], 0)
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(2, 13):
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(value.sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, open_rooms = [], 0  # open_rooms: bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = open_rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        rooms[b] = room = room - n
        by_room[room].append(b)
        open_rooms |= 1 << room
    return bins, offsets, np.array(rooms, np.int64)


ITEM = "row long, piece int, length long"


def _pack_groups(items: DataFrame, capacity: int, label: int) -> DataFrame:
    """items (with ``dealt``) packed in their groups: sequence (a string), offset, and certified: the group meets its
    bound. Of the other groups the sequences that are not full are ``open``."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        group = rows.column("dealt")[0].as_py()
        certified = bool(len(rooms) <= lower_bound(lengths, capacity))
        return pa.table({
            "row": rows.column("row"), "piece": rows.column("piece"), "length": rows.column("length"), "sequence": pa.array([f"{label}-{group}-{b}" for b in bins.tolist()], pa.string()),
            "offset": pa.array(offsets, pa.int64()), "certified": pa.array([certified] * len(bins), pa.bool_()), "open": pa.array((rooms > 0)[bins] & (not certified), pa.bool_()),
        })

    return items.groupBy("dealt").applyInArrow(pack, ITEM + ", sequence string, offset long, certified boolean, open boolean")


def pack(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Per piece: row, doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified (whether its group meets
    the bound, so that no packing of the group's pieces takes fewer sequences).

    Every document gives at least one piece (its end id), so null and empty texts are packed as well; repeated rows and
    null ids are told apart by ``row``. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    cut_pieces = stored(pieces(docs, text_col, path, capacity), "pieces")
    left, placed, before = cut_pieces.where(F.col("length") < capacity).select("row", "piece", "length"), None, None
    for k in count():
        n = left.count()
        if not n:
            break
        groups = math.ceil(n / group_pieces)
        dealt = left.select("row", "piece", "length").withColumn("dealt", F.pmod(F.xxhash64("row", "piece", F.lit(k)), F.lit(groups)).cast("int"))
        done = cut(_pack_groups(dealt, capacity, k))
        took = done.select("sequence").distinct().count()
        if before is not None and took >= before:  # the exchange saved nothing: the pool stays as it was
            placed = placed.unionByName(left)
            break
        fixed, pool = done.where("NOT open"), done.where("open")
        placed = fixed if placed is None else placed.unionByName(fixed)
        if groups == 1:
            placed = placed.unionByName(pool)
            break
        left, before = pool, pool.select("sequence").distinct().count()
    full = cut_pieces.where(F.col("length") >= capacity).withColumn("sequence", F.concat_ws("-", F.lit("f"), "row", "piece")).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    if placed is not None:
        part = cut_pieces.where(F.col("length") < capacity).join(placed.select("row", "piece", "sequence", "offset", "certified"), ["row", "piece"])
        full = full.unionByName(part)
    # A sequence's number comes from its name: 63 bits of a hash would do but for chance, so names are numbered by sorting.
    return _numbered(full)


def _numbered(rows: DataFrame) -> DataFrame:
    names = cut(rows.select("sequence").distinct().sortWithinPartitions("sequence").withColumn("sequence_id", F.monotonically_increasing_id()))
    return rows.join(names, "sequence").select("row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("row")
