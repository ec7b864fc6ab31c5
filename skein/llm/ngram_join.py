"""N-gram Jaccard self-join by partitioning the universe (pigeonhole), exact.

A document is the set of hashes of its five-word shingles. Two sets of sizes r >= s with Jaccard similarity of at least
3/4 differ in at most H = (r + s) // 7 shingles. Sizes are split into bands that grow by 4/3, so a partner is in the same
band or the next lower one. For each band the universe of hashes is split into m segments, the same for all documents of
the band and for those that look into it. At most H segments can hold a difference, so of any H + 1 segments in which a
document has shingles one is the same in both. Each document puts a signature of each such segment in the index.

Cost-based allocation: signatures that many documents share cost most. As m is chosen larger than H + 1, a document can do
without its most frequent segments as long as H + 1 others remain. Both sides take their segments in one order, the rarest
first, so two similar documents that share no rare segment meet in a frequent run among the first H + 1 of both. In tiny
sets, where H is 1 at most, two similar sets differ in one shingle that only the larger one has: the smaller set is
indexed whole and the larger one asks with its one-deletion neighbourhood.

Frequent runs are not paired out. Each document of a run is held against a few centres of the run (the one with the fewest
rare segments, the text that the others were made from, if there is one, and some that are drawn); a run whose documents
are all in one component needs no more. What remains after rounds that no longer help are documents of different
components in one run: these, and only these, are compared block against block.

No task has to hold all documents of a signature: of documents with one set only one is signed, and signatures that very
many sets share are found by counting beforehand. They are not sent to the task of their slot; the documents that hold
them are dealt out by document instead, as members of a frequent run.

Votes (equal segments) bound the difference from below, which drops most false candidates; what remains is verified by
intersecting the sets themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, many_to_one, often, release, ship, stored, table, tidy
from .components import components

SHINGLE_WORDS = 5
SLOT_KEYS = 1 << 19
LEAST_SLOTS = 16  # of a band: as many tasks at any size, and rows that grow with the documents
LONG_RUN = 16
BROADCAST_IDS = 500_000
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20  # of texts or sets that are worked on at once
WORDS_KEPT = 1 << 17
HOT_RUN = 1 << 15  # holders of a signature beyond which they don't meet in one task
HOT_KEYS = 1 << 20  # signatures that count as hot at most; with more of them, the bound above doubles
TALLY_KEYS = 1 << 20  # signatures counted at a time
TALLY_LEAST = 4  # holders among these from which a signature is reported; what stays below it in all counts is no hot run
CENTRES = 2  # of a run, in each round
ENOUGH = 0.75  # rounds go on while each leaves at most this share of the documents in open runs
FEW_OPEN = 1 << 14  # documents whose few blocks cost less than another round
BLOCK_ROWS, BLOCK_TOKENS = 1536, 1 << 19


class _WordHashes(dict):
    """The hashes of words met, for one worker; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors, one for each place of a shingle.
PLACES = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 | 1) & 0xFFFFFFFFFFFFFFFF) for k in range(SHINGLE_WORDS)]
_NO_KEYS = np.empty(0, np.uint64)


def shingle_sets(texts: list[str | None], words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's five-word shingles, one set behind the other, and their sizes.

    bytes.lower() and bytes.split() know ASCII only, which is the contract's A-Z and white space. Fewer words: the whole
    sequence, with its length; none: an empty set.
    """
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    h = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = [h * p for p in PLACES]
    total = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE_WORDS):
        total[: max(0, len(h) - k)] += place[k][k:]
    total = _mixed(total + np.uint64(SHINGLE_WORDS))
    owner = np.repeat(np.arange(len(texts)), lengths)
    good = np.arange(len(h)) + SHINGLE_WORDS <= ends[owner]
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE_WORDS)).tolist():
        a, n = int(starts[i]), int(lengths[i])
        total[a] = _mixed(np.array([sum(int(place[k][a + k]) for k in range(n)) + n & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
        good[a] = True
    tokens, owner = total[good], owner[good]
    sizes = np.bincount(owner, minlength=len(texts))
    at = 0
    for n in sizes.tolist():
        tokens[at : at + n].sort()
        at += n
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.bincount(owner[new], minlength=len(texts))


@lru_cache(1)
def band_starts() -> np.ndarray:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(-(-4 * starts[-1] // 3))
    return np.array(starts, np.int64)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(band_starts(), n, "right") - 1


@lru_cache(1)
def layouts() -> tuple[np.ndarray, np.ndarray]:
    """The largest size and the number of segments of each band; 0 segments: tiny sets. The cheaper the fewer signatures:
    m just above what leaves H + 1 segments with shingles for practically all documents; small sets get so many that each
    shingle is alone."""
    top = band_starts()[1:] - 1
    return top, np.where(top <= 5, 0, np.where(top < 256, 1 << 20, np.ceil(0.42 * top))).astype(np.int64)


def targets(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, bands): the bands in which sets look for partners of their size or less, own bands first. Sets of one
    or two shingles are similar to none but themselves."""
    own, top = band_of(np.maximum(sizes, 1)), layouts()[0]
    for band in (own, own - 1):
        docs = np.flatnonzero((sizes > 2) & (band >= 0) & (4 * np.minimum(sizes, top[band]) >= 3 * sizes))
        yield docs, band[docs]


def needed(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Segments, one of which two similar documents share, for a document of size n in a band's index: H + 1 for the
    largest partner that it looks for there or, in its own band, that looks for it."""
    need = (n + np.minimum(n, layouts()[0][band])) // 7 + 1
    return np.where(band_of(n) == band, np.maximum(need, n // 3 + 1), need)


def signatures(tokens: np.ndarray, sizes: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner): the signatures, 64 bits each, of sets (one behind the other) for the indexes of their bands."""
    m = layouts()[1][bands]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    body = _mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    seed = _mixed(bands.astype(np.uint64))
    tiny = m == 0
    in_tiny = tiny[owner]
    t, o, b = tokens[~in_tiny], owner[~in_tiny], body[~in_tiny]
    segment = ((t >> np.uint64(32)) * m[o].astype(np.uint64)) >> np.uint64(32)  # rises with the token
    keys, owners = _NO_KEYS, np.empty(0, np.int64)
    if len(t):
        first = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (o[1:] != o[:-1])))
        owners = o[first]
        keys = _mixed(np.add.reduceat(b, first) + segment[first] * np.uint64(0x9E3779B97F4A7C15) + seed[owners])
    if tiny.any():
        whole = np.zeros(len(sizes), np.uint64)
        np.add.at(whole, owner[in_tiny], body[in_tiny])
        index = np.flatnonzero(tiny & (band_of(sizes) == bands))
        ask, less = owner[in_tiny], body[in_tiny]
        asks = sizes[ask] > 3  # a partner has one shingle less
        ask, less = ask[asks], less[asks]
        keys = np.concatenate([keys, _mixed(whole[index] + seed[index]), _mixed(whole[ask] - less + seed[ask])])
        owners = np.concatenate([owners, index, ask])
    return keys, owners


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and of bytes in a column (more only for a single row)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + SLICE_ROWS]), SLICE_BYTES, "right")))
        yield batch.slice(at, n)
        at += n


def _blobs(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of counts[i] items each, one behind the other."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _arrays(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The items of binary values without nulls, one value behind the other, and their counts."""
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), counts // np.dtype(kind).itemsize


class _Tally:
    """Counts the signatures of a task's different sets, and reports those that many of them hold."""

    def __init__(self, least: int):
        self.least, self.keys, self.size, self.seen = least, [], 0, set()

    def add(self, tokens: np.ndarray, sizes: np.ndarray, digests: list[bytes]) -> None:
        new = np.array([not (d in self.seen or self.seen.add(d)) for d in digests], bool)
        tokens, sizes = tokens[np.repeat(new, sizes)], sizes[new]
        starts = np.cumsum(sizes) - sizes
        for docs, bands in targets(sizes):
            keys, _ = signatures(_picked(tokens, starts[docs], sizes[docs]), sizes[docs], bands)
            self.keys.append(keys)
            self.size += len(keys)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort(np.concatenate(self.keys)) if self.keys else _NO_KEYS
        self.keys, self.size, self.seen = [], 0, set()
        if not len(key):
            return key, np.empty(0, np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(first, len(key)))
        return key[first[length > self.least]], length[length > self.least]


def _picked(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sets that begin at starts, one behind the other."""
    if int(sizes.sum()) == len(tokens):
        return tokens
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return tokens[np.arange(len(shift)) + shift]


SETS_DDL = "row long, doc_id long, n long, digest binary, tokens binary"


def measured(docs: DataFrame, tally_least: int = TALLY_LEAST) -> DataFrame:
    """docs: (row, doc_id, text). Per row: row, doc_id, n (size of its set), digest (128 bits that stand for the set) and
    tokens (the set). Rows with n = -1 hold in tokens signatures that many sets of a task share, and their counts."""
    names = ["row", "doc_id", "n", "digest", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tally = _WordHashes(), _Tally(tally_least)

        def report() -> pa.RecordBatch:
            keys, counts = tally.flush()
            blob = np.stack([keys, counts.astype(np.uint64)], 1).tobytes()
            none = pa.array([None], pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array([-1], pa.int64()), pa.array([None], pa.binary()), pa.array([blob], pa.binary())], names)

        for batch in batches:
            for part in _slices(batch, 2):
                tokens, sizes = shingle_sets(part.column(2).to_pylist(), words)
                ends = np.cumsum(sizes)
                digests = [hashlib.blake2b(tokens[b - n : b].tobytes(), digest_size=16).digest() for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                tally.add(tokens, sizes, digests)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _blobs(tokens, sizes)], names)
                if tally.size >= TALLY_KEYS:
                    yield report()
        yield report()

    return docs.mapInArrow(tidy(run), SETS_DDL)


def hot_signatures(tallies: DataFrame, hot_run: int, most: int = HOT_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """The signatures with more than hot_run holders, in order, and their counts. They come to the driver and go to all
    tasks, so there are ``most`` of them at most: with more, the bound doubles until there are not."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = np.frombuffer(blob, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["key", "n"])

    counted = cut(tallies.select("tokens").mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot_run))
    while counted.where(F.col("n") > hot_run).count() > most:
        hot_run = max(1, 2 * hot_run)
    rows = counted.where(F.col("n") > hot_run).collect()
    keys, counts = np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _band(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(int(x)) for x in band_starts()]), lambda x: x <= n)) - 1


def slot_plan(sizes: DataFrame, slot_keys: int) -> dict[int, int]:
    """Slots of each band, so that a slot holds about slot_keys signatures. One row per band comes to the driver."""
    top, m = layouts()
    total: dict[int, float] = {}
    for r in sizes.where("n > 0").groupBy(_band(F.col("n")).alias("band")).agg(F.sum("n").alias("n")).collect():
        for b in (r.band, r.band - 1):
            if b >= 0:
                total[b] = total.get(b, 0) + r.n * min(1.0, 0.95 * (m[b] or top[b]) / top[b])
    return {b: max(LEAST_SLOTS, math.ceil(n / slot_keys)) for b, n in total.items()}


SIGNED_DDL = "slot long, id long, n long, segments long, keys binary"
UNLUCKY_SLOTS = 1024  # slots below 0
SLOTS_PER_BAND = 1 << 40
NONE_HOT = _NO_KEYS, np.empty(0, np.int64)


def signed(sets: DataFrame, slots: dict[int, int], hot: np.ndarray = NONE_HOT[0], hot_slots: int = LEAST_SLOTS) -> DataFrame:
    """sets: (id, n, tokens). Per set and slot the low 32 bits of its signatures there; slots below 0: it has too few
    segments; slots below -UNLUCKY_SLOTS, by id: its band and the whole of its hot signatures, which are nowhere else."""
    count_of = np.array([slots.get(b, 1) for b in range(len(band_starts()))], np.uint64)
    names = ["slot", "id", "n", "segments", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                tokens, sizes = _arrays(part.column(2), np.uint64)
                ids, starts = part.column(0).to_numpy(), np.cumsum(sizes) - sizes
                for docs, bands in targets(sizes):
                    if len(docs):
                        yield from signed_in(_picked(tokens, starts[docs], sizes[docs]), sizes[docs], bands, ids[docs])

    def signed_in(tokens: np.ndarray, sizes: np.ndarray, bands: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        def batch(slot, doc, keys: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(ids[doc]), pa.array(sizes[doc]), pa.array(segments[doc]), keys], names)

        keys, owner = signatures(tokens, sizes, bands)
        segments = np.bincount(owner, minlength=len(sizes))
        plain = layouts()[1][bands] > 0
        unlucky = np.flatnonzero(plain & (segments < needed(sizes, bands)))
        if len(unlucky):
            yield batch(-1 - ids[unlucky] % UNLUCKY_SLOTS, unlucky, _blobs(_NO_KEYS, np.zeros(len(unlucky), np.int64)))
        if len(hot):
            hit = (hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys) & plain[owner]
            if hit.any():
                order = np.argsort(owner[hit], kind="stable")
                who, key = owner[hit][order], keys[hit][order]
                docs, n = np.unique(who, return_counts=True)
                with_band = np.insert(key, np.cumsum(n) - n, bands[docs].astype(np.uint64))
                slot = _mixed(ids[docs].astype(np.uint64)) % np.uint64(hot_slots)
                yield batch(-1 - UNLUCKY_SLOTS - slot.astype(np.int64), docs, _blobs(with_band, n + 1))
                keys, owner = keys[~hit], owner[~hit]
        if not len(keys):
            return
        slot = bands[owner] * SLOTS_PER_BAND + ((keys >> np.uint64(32)) % count_of[bands[owner]]).astype(np.int64)
        order = np.lexsort((slot, owner))
        slot, owner, low = slot[order], owner[order], keys.astype(np.uint32)[order]
        first = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1])))
        yield batch(slot[first], owner[first], _blobs(low, np.diff(np.append(first, len(low)))))

    return sets.select("id", "n", "tokens").mapInArrow(tidy(run), SIGNED_DDL)


FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("band", pa.int32()), ("run", pa.int64()), ("votes", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("segments", pa.int64()), ("need", pa.int64())])
FOUND_DDL = "kind int, a long, b long, band int, run long, votes long, na long, nb long, segments long, need long"
PAIR, HOT, UNLUCKY = 0, 1, 2


def _found(kind: int, a, b=None, band=0, run=0, votes=0, na=0, nb=0, segments=0, need=0) -> pa.Table:
    values = [kind, a, 0 if b is None else b, band, run, votes, na, nb, segments, need]
    full = [v if isinstance(v, np.ndarray) else np.full(len(a), v) for v in values]
    return pa.Table.from_arrays([pa.array(v.astype(f.type.to_pandas_dtype()), f.type) for v, f in zip(full, FOUND, strict=True)], schema=FOUND)


def _hot_members(rows: pa.Table, hot: np.ndarray, counts: np.ndarray) -> pa.Table:
    """The members of hot runs, from the rows of some documents."""
    ids, n, have = (rows.column(c).to_numpy() for c in ("id", "n", "segments"))
    blobs = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
    bands = np.array([int(x[0]) for x in blobs])
    who = np.repeat(np.arange(len(ids)), [len(x) - 1 for x in blobs])
    key = np.concatenate([x[1:] for x in blobs])
    return _found(HOT, ids[who], None, bands[who], _mixed(key).view(np.int64), counts[np.searchsorted(hot, key)], n[who], 0, have[who], needed(n, bands)[who])


def _matches(rows: pa.Table, long_run_of: int, hot_keys: tuple[np.ndarray, np.ndarray] = NONE_HOT) -> pa.Table:
    """What one slot shows: pairs with their votes from short runs of equal signatures, and the members of long runs."""
    slot = rows.column("slot")[0].as_py()
    if slot < -UNLUCKY_SLOTS:
        return _hot_members(rows, *hot_keys)
    ids, n, have = (rows.column(c).to_numpy() for c in ("id", "n", "segments"))
    if slot < 0:
        return _found(UNLUCKY, ids, na=n)
    band = slot // SLOTS_PER_BAND
    own = band_of(n) == band
    parts = [_arrays(chunk, np.uint32) for chunk in rows.column("keys").chunks]
    key, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    member = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    by = np.lexsort((member, key))
    key, member = key[by], member[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(first, len(key)))
    tiny = layouts()[1][band] == 0
    if tiny:  # the whole of a set, among the deletions of larger ones
        holder = member[first[np.repeat(np.arange(len(first)), length)]]
        at = np.flatnonzero(own[member] & (np.repeat(length, length) > 1))
        pairs = [(member[first[r] : first[r] + length[r]], k) for k, r in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist(), strict=True)]
        x = np.concatenate([p for p, _ in pairs]) if pairs else holder[:0]
        y = np.concatenate([np.full(len(p), member[k]) for p, k in pairs]) if pairs else holder[:0]
        good = n[x] == n[y] + 1
        return _found(PAIR, ids[x[good]], ids[y[good]], band, 0, 1, n[x[good]], n[y[good]], 1)
    long_run = np.repeat(length > long_run_of, length)
    packed, votes = np.empty(0, np.int64), np.empty(0, np.int64)
    for step in range(1, long_run_of):
        i = np.flatnonzero((key[step:] == key[:-step]) & ~long_run[step:])
        if not len(i):
            break
        new, n_new = np.unique((member[i].astype(np.int64) << 32) | member[i + step], return_counts=True)
        both = np.concatenate([packed, new])
        packed, where = np.unique(both, return_inverse=True)
        votes = np.bincount(where, np.concatenate([votes, n_new]), len(packed)).astype(np.int64)
    x, y = packed >> 32, packed & 0xFFFFFFFF
    larger = (n[x] > n[y]) | ((n[x] == n[y]) & (ids[x] > ids[y]))  # by id, as slots that hold a pair in different orders must name it alike
    a, b = np.where(larger, x, y), np.where(larger, y, x)
    good = own[b] & (4 * n[b] >= 3 * n[a])
    a, b, votes = a[good], b[good], votes[good]
    out = [_found(PAIR, ids[a], ids[b], band, 0, votes, n[a], n[b], have[a])]
    if long_run.any():
        hot = np.flatnonzero(long_run)
        who = member[hot]
        run = _mixed((key[hot].astype(np.uint64) << np.uint64(32)) ^ _mixed(np.array([slot], np.uint64))).view(np.int64)
        out.append(_found(HOT, ids[who], None, band, run, np.repeat(length, length)[hot], n[who], 0, have[who], needed(n[who], np.full(len(who), band))))
    return pa.concat_tables(out)


def _of_ids(sets: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of sets whose id is in ids (or is not): ids are sent to all executors only while they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return sets.join(F.broadcast(ids) if few else ids, "id", how)


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids in pairs (a, b), each once."""
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least 3/4. sets: (id, tokens); pairs are cut, and many
    may have one b."""
    few = _of_ids(sets.select("id", "tokens"), _ends(pairs))
    sent = F.broadcast(pairs) if pairs.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2 else pairs  # two ids each
    first = few.select(F.col("id").alias("a"), F.col("tokens").alias("ta")).join(sent, "a")
    second = few.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    hot = often(pairs, ["b"])
    both = (first.join(second, "b") if hot is None else many_to_one(first, second, ["b"], hot=hot)).select("a", "b", "ta", "tb")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    inter = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * inter >= 75 * (len(p) + len(q) - inter))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(alike), "a long, b long")


def jaccard_links(sets: DataFrame, slot_keys: int = SLOT_KEYS, long_run: int = LONG_RUN, hot_keys: tuple[np.ndarray, np.ndarray] = NONE_HOT, spent: DataFrame | None = None) -> DataFrame:
    """sets: (id, n, tokens), all ids and all sets different. Returns links (a, b), verified, that join all ids that
    similarity joins; pairs inside a component may be left out.

    Only sets that may have a link are held against each other; they are stored anew, and spent (the stored table that sets
    are read from, if nobody needs it any longer) is deleted before."""
    slots = slot_plan(sets, slot_keys)
    if not slots:
        return cut(sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    hot_slots = max(LEAST_SLOTS, math.ceil(float(hot_keys[1].sum()) / slot_keys))
    rows = signed(sets, slots, hot_keys[0], hot_slots)
    found = stored(rows.groupBy("slot").applyInArrow(lambda rows: (_matches(rows, long_run, hot_keys), release())[0], FOUND_DDL), "found")
    hot = found.where(F.col("kind") == HOT)
    # How many of a document's segments in a band are frequent ones; without them, has it enough?
    burden = hot.groupBy("a", "band").agg(F.count("*").alias("frequent"), F.first("segments").alias("segments"), F.first("need").alias("need"))
    burden = cut(burden.withColumn("rare", F.col("segments") - F.col("frequent")).withColumn("missing", F.col("need") - F.col("rare")))
    pairs = found.where(F.col("kind") == PAIR).groupBy("a", "b", "band").agg(F.sum("votes").alias("votes"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("segments").alias("segments"))
    pairs = pairs.join(burden.select("a", "band", "frequent"), ["a", "band"], "left")
    tiny = F.col("band").isin([int(b) for b in np.flatnonzero(layouts()[1] == 0)])
    enough = F.col("votes") + F.coalesce("frequent", F.lit(0)) >= F.col("segments") - F.floor((F.col("na") + F.col("nb")) / 7)
    tries = cut(pairs.where(tiny | enough).select("a", "b").distinct())
    lacking = cut(found.where(F.col("kind") == UNLUCKY).select("a", F.col("na").alias("n")).distinct())
    if not lacking.isEmpty():  # next to never: each is held against the documents of its two bands
        other = sets.where("n > 0").select(F.col("id").alias("b"), F.col("n").alias("nb"), _band(F.col("n")).alias("band"))
        query = lacking.select("a", "n", F.explode(F.sequence(_band(F.col("n")) - 1, _band(F.col("n")) + 1)).alias("band"))
        small, large = F.least("n", "nb"), F.greatest("n", "nb")
        near = query.join(other, "band").where((4 * small >= 3 * large) & (F.col("a") != F.col("b")))
        tries = cut(tries.unionByName(near.select("a", "b")))
    needy = cut(burden.where((F.col("missing") > 0) & (F.col("rare") < F.col("need"))).select("a", "band", "missing", "rare"))
    wanted = cut(_ends(tries).unionByName(needy.select(F.col("a").alias("id"))).distinct())
    sets = stored(_of_ids(sets.select("id", "tokens"), wanted), "near-sets")
    if spent is not None:
        discard(spent)
    links = _frequent_links(sets, hot, needy, cut(verified(sets, tries)))
    discard(found)
    discard(sets)
    return links


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the root of their component, those of runs with more than one component only."""
    roots = components(links).select(F.col("id").alias("a"), "root")
    known = cut(members.join(roots, "a", "left").withColumn("root", F.coalesce("root", "a")))
    open_runs = known.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("run")
    return cut(known.join(open_runs, "run", "left_semi"))


def _frequent_links(sets: DataFrame, hot: DataFrame, needy: DataFrame, links: DataFrame) -> DataFrame:
    """links, and those among documents of frequent runs that join further documents. needy: (a, band, missing, rare), the
    documents that have too few rare segments.

    A document is a member of its cheapest frequent runs, as many as its rare segments are short of H + 1; those with
    enough rare segments are members of none. Two documents that share no rare segment differ in all of those.
    """
    if needy.isEmpty():
        return links
    cheap = Window.partitionBy("a", "band").orderBy("length", "run")
    rows = hot.select("a", "band", "run", F.col("votes").alias("length"), F.col("na").alias("n")).join(needy, ["a", "band"])
    members = cut(rows.withColumn("k", F.row_number().over(cheap)).where("k <= missing").select("run", "a", "n", (F.col("rare") * 1000 / F.col("n")).cast("int").alias("rare")))
    left, open_ = None, members.withColumn("root", F.col("a"))
    for turn in count():
        # One centre is the document with the fewest rare segments, at first; the others are drawn.
        draws = [F.struct(F.xxhash64("a", F.lit(CENTRES * turn + k)).alias("h"), "a") for k in range(CENTRES)]
        draws = draws if turn else [F.struct("rare", "n", "a"), *draws[1:]]
        centres = open_.groupBy("run").agg(*[F.min(d)["a"].alias(f"c{k}") for k, d in enumerate(draws)]).withColumn("c", F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)])))
        tried = many_to_one(open_, centres.select("run", "c"), ["run"]).select("a", F.explode("c").alias("b")).where("a <> b")
        verdicts = verified(sets, cut(tried.distinct()))
        links = cut(links.unionByName(verdicts))
        open_ = _rooted(members, links)
        size = open_.select("a").distinct().count()
        if not size:
            return links
        if size <= FEW_OPEN or (left is not None and size > ENOUGH * left):
            return cut(links.unionByName(_blockwise(sets, open_)))
        left = size


def _blockwise(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links among members (run, a, n, root) of different components. Runs that share documents make a cluster; a
    cluster's documents are dealt to blocks by size band and, where a component fills blocks of its own, by component;
    each two blocks whose sizes are near meet in a task, unless they are of one component."""
    heads = members.groupBy("run").agg(F.min("a").alias("head"))
    clusters = components(members.join(heads, "run").select("a", F.col("head").alias("b"))).select(F.col("id").alias("a"), F.col("root").alias("cluster"))
    docs = members.select("a", "n", "root").distinct().join(clusters, "a").withColumn("band", _band(F.col("n")))
    large = docs.groupBy("cluster", "band", "root").agg(F.count("*").alias("_n")).where(F.col("_n") >= BLOCK_ROWS // 2).select("cluster", "band", "root", F.col("root").alias("part"))
    docs = cut(docs.join(large, ["cluster", "band", "root"], "left").withColumn("part", F.coalesce("part", F.lit(-1).cast("long"))))
    of = ["cluster", "band", "part"]
    counts = docs.groupBy(*of).agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    blocks = cut(counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    x, y = (blocks.select("cluster", *[F.col(c).alias(f"{s}_{c}") for c in ("band", "part", "block")]) for s in "xy")
    after = F.struct("x_part", "x_block") <= F.struct("y_part", "y_block")
    near = (F.col("x_band") == F.col("y_band") + 1) | ((F.col("x_band") == F.col("y_band")) & after)
    apart = (F.col("x_part") != F.col("y_part")) | (F.col("x_part") == -1)
    tasks = cut(x.join(y, "cluster").where(near & apart).withColumn("task", F.monotonically_increasing_id()))
    sides = [tasks.select("cluster", "task", F.lit(s == "x").alias("left"), *[F.col(f"{s}_{c}").alias(c) for c in ("band", "part", "block")]) for s in "xy"]
    dealt = docs.join(counts, of).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    placed = dealt.join(sides[0].unionByName(sides[1]), [*of, "block"]).select("task", "left", "a", "root")
    tokens = stored(_of_ids(sets.select("id", "tokens"), docs.select(F.col("a").alias("id")).distinct()), "block-sets")
    work = placed.join(tokens.select(F.col("id").alias("a"), "tokens"), "a")
    links = cut(work.groupBy("task").applyInArrow(lambda rows: (_block_links(rows), release())[0], "a long, b long"))
    discard(tokens)
    return links


def _block_links(rows: pa.Table) -> pa.Table:
    """The links between documents of different components in two blocks (or in one), as a spanning forest."""
    ids, left, roots = (rows.column(c).to_numpy() for c in ("a", "left", "root"))
    parts = [_arrays(chunk, np.uint64) for chunk in rows.column("tokens").chunks]
    token, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    overlap = np.zeros((len(x), len(y)), np.float32)
    who = np.repeat(np.arange(len(ids)), size)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    new = np.append(True, token[1:] != token[:-1])[: len(token)]
    shared = np.diff(np.append(np.flatnonzero(new), len(token))) > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)[np.cumsum(new) - 1]
    for at in range(0, int(shared.sum()), 2048):
        part = (place >= at) & (place < at + 2048)
        held = np.zeros((len(ids), 2048), np.float32)
        held[who[part], place[part] - at] = 1
        overlap += held[x] @ held[y].T
    linked = (100 * overlap >= 75 * (size[x][:, None] + size[y][None, :] - overlap)) & (overlap > 0) & (roots[x][:, None] != roots[y][None, :])
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    pairs = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        p, q = root(int(roots[x[i]])), root(int(roots[y[j]]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            pairs.append((ids[x[i]], ids[y[j]]))
    return pa.Table.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar_groups(docs: DataFrame, text_col: str = "text", slot_keys: int = SLOT_KEYS, long_run: int = LONG_RUN, hot_run: int = HOT_RUN) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Null and empty texts have an empty set and link with nothing. Rows that repeat an id are one document with the links
    of each of them; a row without an id links with nothing and has no component. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_sets = stored(measured(rows, min(TALLY_LEAST, hot_run)), "sets")
    hot_keys = hot_signatures(all_sets.where("n < 0"), hot_run)
    thin = cut(all_sets.where("n >= 0").drop("tokens"))
    known = cut(thin.where("doc_id IS NOT NULL AND n > 0").select("row", "doc_id", "digest"))
    # Of the rows with one set the first, by id, stands for all.
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    same = cut(many_to_one(known, cut(classes), ["digest"]).select("row", "doc_id", F.col("first.doc_id").alias("first"), F.col("first.row").alias("first_row")))
    gone = same.where("row <> first_row").select(F.col("row").alias("id"))
    sets = all_sets.where("n > 0 AND doc_id IS NOT NULL").select(F.col("row").alias("id"), "n", "tokens")
    links = jaccard_links(_of_ids(sets, cut(gone), "left_anti"), slot_keys, long_run, hot_keys, all_sets)
    of = known.select("row", "doc_id")
    named = many_to_one(links, of.select(F.col("row").alias("a"), F.col("doc_id").alias("da")), ["a"])
    named = many_to_one(cut(named.select("b", "da")), of.select(F.col("row").alias("b"), F.col("doc_id").alias("db")), ["b"])
    roots = components(named.select(F.col("da").alias("a"), F.col("db").alias("b")).unionByName(same.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))))
    discard(all_sets)
    return thin.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of similar documents the one with the smallest
    id, and all rows without an id, words or text. Rows that repeat an id stay or go together."""
    gone = similar_groups(docs, text_col).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
