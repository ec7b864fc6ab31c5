"""The training-data operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import base64
import gzip
import hashlib
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, common, exact_dedup, fingerprints, language_id, license_scan, mixing, ngram_join, packing, surrogates, tokens, warc_zip
from skein.llm.common import many_to_one
from skein.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, rows):
    full = [(i, t, None, s if s is None else str(s), 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).select("*", F.lit(1).alias("row"), F.lit("x").alias("name"), F.lit(2).alias("n"), F.lit(3).alias("size"), F.lit(4).alias("kept"))


def some_rows(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = " ".join(rng.choice(words) for _ in range(120))
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200))), k % 5) for k in range(n)]
    for k in range(n, n + 25):  # near copies
        w = base.split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w), 0))
    long = " ".join(rng.choice(words) for _ in range(20000))
    rows += [(900, None, None), (901, "", 1), (902, " \n\t", 1), (903, "one", 2), (904, "One two", 2), (905, "one  two", 2), (906, long, 0), (907, long + " end", 0), (None, "one two", 3), (903, "one", 2), (908, "É È ß 漢字 \U0001f600", None)]
    return rows


def test_exact_dedup_against_brute_force(spark):
    rows = some_rows() + [(950, "a b", 1), (951, "ab", 1), (952, "x" * 5000 + " y", 1), (953, "x" * 5000 + "y", 1), (954, "x" * 4999 + "y", 1)]
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t, _ in rows]
    groups = defaultdict(list)
    for k, t in enumerate(norm):
        groups[t].append(k)
    want = []
    for t, members in groups.items():
        best = min(members, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        want += [(rows[k][0], rows[best][0], len(members), k == best, hashlib.sha256(t.encode()).hexdigest()) for k in members]
    # A hash with four values makes different blocks meet under one hash all the time.
    for size, h in ((64, F.xxhash64), (1000, lambda b: F.pmod(F.xxhash64(b), F.lit(4)))):
        got = exact_dedup.exact_groups(documents(spark, rows), block_chars=size, block_hash=h).drop("row").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = exact_dedup.exact_dedup(documents(spark, rows))
    assert kept.count() == len(groups) and kept.columns == documents(spark, rows[:1]).columns


def test_empty_tables(spark):
    none = documents(spark, [(1, "x", 1)]).where("doc_id = 2")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (exact_dedup.exact_groups(none), mixing.mix(none), ngram_join.similar_groups(none), packing.pack(none), license_scan.license_labels(none), language_id.identify(none), fingerprints.with_edited(none), surrogates.replace_pii(none), warc_zip.archive(pages), chat.rendered(chats)):
        assert df.count() == 0


def filled(sizes, most=3.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= most * sizes[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_targets_and_quotas(spark):
    rows = some_rows(2, 200)
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for i, t, s in rows:
        sizes[None if s is None else str(s)] += len(WORD.findall(t or ""))
    target = filled(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 40 + 0.01 * target[s]
    again = mixing.mix(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)


def test_sainte_lague_against_the_plain_rule(spark):
    rng = random.Random(8)
    for seats in (0, 1, 7, 1000):
        claims = [(k, float(rng.choice([0, 1, 3, 50, 50, 700]))) for k in range(12)]
        df = spark.createDataFrame(claims, "k int, claim double").withColumn("seats", F.lit(seats))
        got = {r.k: r.quota for r in mixing.sainte_lague(df, [], ["k"], "claim", "seats").collect()}
        want = dict.fromkeys(range(12), 0)
        for _ in range(seats):
            best = max((x for x in claims if x[1] > 0), key=lambda x: (x[1] / (2 * want[x[0]] + 1), -x[0]))
            want[best[0]] += 1
        assert got == want


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {}
    for k, (i, t, _) in enumerate(rows):
        sets[k] = shingles(t)
    parent = {i: i for i, _, _ in rows if i is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(rows[a][0]), root(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return [(i, len(sets[k]), None if i is None else root(i)) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("slot_keys,long_run", [(1 << 19, 16), (500, 2)])
def test_ngram_join_against_brute_force(spark, slot_keys, long_run):
    rows = some_rows(3)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))  # one passage in many documents that are otherwise different
    rows += [(1000 + k, passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(0, 60))), 1) for k in range(40)]
    rows += [(2000 + k, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(5, 12))), 1) for k in range(60)]  # tiny sets
    got = ngram_join.similar_groups(documents(spark, rows), slot_keys=slot_keys, long_run=long_run).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_components(rows), key=str)


@pytest.mark.parametrize("hot_run", [0, 5])
def test_ngram_join_with_hot_signatures(spark, hot_run):
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [r for r in some_rows(3) if r[0] not in (906, 907)] + [(1000 + k, passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(0, 60))), 1) for k in range(120)]
    rows += [(3000 + k, rows[70][1], 1) for k in range(150)] + [(3000, "one two", 1), (1001, rows[70][1], 1)]
    rows += [(5000 + k, " ".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))), 1) for k in range(60)]
    docs = documents(spark, rows)
    got = ngram_join.similar_groups(docs, hot_run=hot_run).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_components(rows), key=str)


def test_votes_of_sets_of_equal_size_add_up_in_any_order_of_rows():
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 2**63, 60, dtype=np.uint64))
    other = np.sort(np.concatenate([base[4:], rng.integers(0, 2**63, 4, dtype=np.uint64)]))
    sizes = np.array([60, 60])
    bands = ngram_join.band_of(sizes)
    keys, owner = ngram_join.signatures(np.concatenate([base, other]), sizes, bands)
    segments, slot_of = np.bincount(owner), (keys >> np.uint64(32)) % np.uint64(16)
    votes = Counter()
    for slot in range(16):
        order = [0, 1] if slot % 2 else [1, 0]
        held = [keys[(owner == d) & (slot_of == slot)].astype(np.uint32).tobytes() for d in order]
        number = int(bands[0]) * ngram_join.SLOTS_PER_BAND + slot
        rows = pa.table({"slot": pa.array([number] * 2, pa.int64()), "id": pa.array(order, pa.int64()), "n": pa.array([60, 60], pa.int64()), "segments": pa.array(segments[order], pa.int64()), "keys": pa.array(held, pa.binary())})
        for row in ngram_join._matches(rows, 16).to_pylist():
            votes[row["a"], row["b"]] += row["votes"]
    assert len(votes) == 1 and next(iter(votes.values())) >= segments[0] - 120 // 7


def test_links_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(21)
    rows = []
    for k in range(60):  # copies of equal length, each with one word exchanged
        body = [f"e{k}x{j}" for j in range(90)]
        for c in range(3):
            own = list(body)
            own[10 + 30 * c] = f"o{k}x{c}"
            rows.append((3 * k + c, " ".join(own), 1))
    for _ in range(2):
        rng.shuffle(rows)
        got = ngram_join.similar_groups(documents(spark, rows).repartition(8), slot_keys=64).collect()
        assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_no_slot_holds_all_documents_of_a_signature(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"q{k}x{j}" for j in range(20))) for k in range(400)] + [(1000 + k, "a copy of one text of some words") for k in range(400)]
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, doc_id long, text string")
    sets = ngram_join.measured(docs.repartition(4))
    hot = ngram_join.hot_signatures(sets.where("n < 0"), 100)
    assert len(hot[0]) >= 56 and 390 <= min(hot[1]) <= max(hot[1]) == 400  # a segment can hold another shingle as well
    assert len(ngram_join.hot_signatures(sets.where("n < 0"), 2, most=100)[0]) <= 100
    sets = sets.where("n > 0 AND row < 1001").select(F.col("row").alias("id"), "n", "tokens")
    slots = dict.fromkeys(range(40), 1 << 20)
    signed = ngram_join.signed(sets, slots, hot[0], 64)
    assert signed.groupBy("slot").count().agg(F.max("count")).first()[0] < 40
    before = ngram_join.signed(sets, slots)  # the same without counting first
    assert before.groupBy("slot").count().agg(F.max("count")).first()[0] >= 400


def template_pages(rng, n, first_id):
    """Pages of one template: near enough to share most shingles, some of them near enough to link."""
    body = [f"t{k}" for k in range(80)]
    rows = []
    for k in range(n):
        w = list(body)
        at = rng.randrange(0, 60)
        w[at : at + rng.choice([1, 4, 8, 12])] = [f"u{rng.randrange(30)}" for _ in range(rng.choice([1, 4, 8, 12]))]
        rows.append((first_id + k, " ".join(w), 1))
    return rows


@pytest.mark.parametrize("options", [{}, {"long_run": 2, "slot_keys": 300}, {"hot_run": 5}])
def test_ngram_join_of_pages_of_templates(spark, monkeypatch, options):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "CENTRES", 1)
    monkeypatch.setattr(ngram_join, "FEW_OPEN", 40)
    rng = random.Random(12)
    rows = template_pages(rng, 150, 1)
    pool = [[f"m{p}x{k}" for k in range(9)] for p in range(8)]
    rows += [(1000 + k, " ".join(w for p in rng.sample(pool, 6) for w in p), 1) for k in range(120)]  # mosaics of passages
    rows += [(2000 + k, " ".join(f"s{j}" for j in range(3 * k, 3 * k + 60)), 1) for k in range(60)]  # a chain
    got = ngram_join.similar_groups(documents(spark, rows), **options).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_many_to_one_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("skein.llm.common.PLAIN_ROWS", 0)
    left = spark.range(5000).select("id", F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k")).union(spark.createDataFrame([(-1, None)], "id long, k long"))
    right = spark.createDataFrame([(1, "a"), (4000, "b")], "k long, v string")
    got = {r.id: r.v for r in many_to_one(left, right, ["k"], "left").collect()}
    assert len(got) == 5001 and all(got[i] == ("a" if 0 <= i < 3000 else "b" if i == 4000 else None) for i in got)
    assert many_to_one(left, right, ["k"]).count() == 3001 and many_to_one(left.limit(0), right, ["k"]).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    brute = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            brute[a] = brute[b] = min(brute[a], brute[b])
    assert got == {x: r for x, r in brute.items() if any(x in e and e[0] != e[1] for e in links)}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(packing.tokenizer_path())
    rows = some_rows(4)
    got = packing.pack(documents(spark, rows)).collect()
    lines = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*code.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = packing.piece_starts(len(ids), 2048)
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert lines == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 1


def test_bounds_hold_and_groups_exchange(spark):
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, rooms = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= len(rooms)
        assert all(x[bins == b].sum() + rooms[b] == 100 for b in range(len(rooms)))
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    rows = [(k, "a " * (k % 37), 0) for k in range(400)]
    got = packing.pack(documents(spark, rows), capacity=64, group_pieces=40).collect()
    # Each of the ten groups may be up to one sequence above its share of the whole bound.
    assert len({r.sequence_id for r in got}) <= packing.lower_bound(np.array([r.length for r in got]), 64) + 10


def test_tokens_equal_the_tokenizers(spark):
    from skein.llm.tokens import encoder

    e = encoder(packing.tokenizer_path())
    rng = random.Random(1)
    letters = " \n\t\r'’.,!?abstmdvrelABéüß漢字12３½  ​\x1c\x85é😀￾𝒜"
    texts = ["", "'", "''s", " 's", "don'tx we'll I'm 'S", "a  b", " \n", "x<|endoftext|>y"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids, counts = e.encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == e.whole(t).tolist(), repr(t)
        at += n


def test_license_scan_against_brute_force(spark):
    notice = license_scan.NOTICES["mit"]
    rows = some_rows(6, 20) + [
        (700, "The MIT License, and the mit  license! GNU General Public-License; CC BY", 1), (701, "mit. license apache licenses", 1), (702, notice.upper(), 1),
        (703, " ".join(w for k, w in enumerate(notice.split()) if k not in (11, 30)), 1), (706, " ".join(notice.split()[:24] + ["some", "other", "words", "by", "the", "holder", "here"] + notice.split()[28:]), 1), (704, "émit license x", 1), (705, "cc by cc by cc by", 1),
    ]
    got = license_scan.license_labels(documents(spark, rows)).drop("row").collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert by[702].labels == "mit" and by[702].n_base == 0 and by[702].score == 1.0
    assert by[703].labels == "mit" and 0.5 <= by[703].score < 1
    assert by[706].labels == "mit" and by[706].score >= 0.5  # longer than either half has of the template alone
    assert by[900].labels == "" and by[900].score == 0.0


def test_language_id_learns_from_the_rest_only(spark):
    rng = random.Random(3)
    syllables = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ung", "ich", "ei"], "fr": ["eau", "ou", "que", "é"], "es": ["ción", "os", "ra", "ñ"]}
    rows = []
    for k in range(400):
        lang = sorted(syllables)[k % 4]
        rows.append((k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 40))), lang if k % 7 else None, "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "12 34 !?", "de", "s", 1), (None, "thering anding", "en", "s", 1)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows if i is not None)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[None].lang_pred == "en"
    held = [(out[i].lang_pred == sorted(syllables)[i % 4]) for i in range(400) if out[i].held_out]
    assert len(held) > 50 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = language_id.known_language(spark.createDataFrame(rows, SCHEMA))
    assert kept.count() == len(rows) - 3 and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_fingerprints_estimate_the_similarity(spark):
    rows = [r for r in some_rows(7) if r[0] is not None]
    got = fingerprints.with_edited(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts[i] = max(t or "", texts.get(i, ""))
    ids = sorted(texts, reverse=True)
    follow = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    by, errors = {r.doc_id: r for r in got}, []
    for i, t in texts.items():
        n = len(t) // 3
        edited = t[: len(t) - n] + texts[follow[i]][:n]
        assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, by[i].near_edited), (texts[follow[i]], by[i].near_next)):
            a, b = shingles(t), shingles(other)
            if a and b:
                errors.append(near - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2
    prints = defaultdict(set)
    for i, t in texts.items():
        prints[t].add(by[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and all(len(by[i].fingerprint) == 256 for i in by)
    lone = fingerprints.with_edited(documents(spark, [(None, "a b c d e f", 1), (5, "x", 1)])).collect()
    assert {r.doc_id for r in lone} == {None, 5} and next(r for r in lone if r.doc_id == 5).near_next == 1.0


def test_warc_round_trip_with_revisits(spark):
    rows = [(1, "http://a/\n x", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, None, None), (4, "v", ""), (5, "w", "é" * 5000), (6, "z", "<p>a</p>"), (6, "z", "<p>a</p>"), (None, "n", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("sha", F.lit(2))
    got = sorted(map(tuple, warc_zip.archive(pages).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for k, (i, _, t) in enumerate(rows):
        best = {"<p>a</p>": 5, "": 3, None: 3, "é" * 5000: 4}[t]
        want.append((i, len((t or "").encode()), digest(t), "response" if k == best else "revisit", None if k == best else rows[best][0]))
    assert got == sorted(want, key=str)
    few = warc_zip.archive(pages, least_bytes=9).where("record_type = 'revisit'")
    assert few.count() == 0


def test_zip64_directory_and_archives_without_an_index(tmp_path):
    records = [warc_zip.warc_record(k, k, "u", b"x" * k, None) for k in range(5)]
    packed = [gzip.compress(r) for r in records]
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as m:
            m.write(b"".join(packed))
        z.comment = b"PK a comment"
    data = path.read_bytes()
    for at, n in warc_zip.records_in(path.as_uri()):
        record = warc_zip.parse_record(gzip.decompress(data[at : at + n]))
        assert record.payload == b"x" * int(record.headers["x-page-id"])
    assert len(list(warc_zip.records_in(path.as_uri()))) == 5


def test_chat_snapshots_collapse(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c <|im_end|>"), ("assistant", None)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns[:2])] + [(2, k, r, t) for k, (r, t) in enumerate(turns)] + [(3, k, r, t) for k, (r, t) in enumerate(turns)] + [(4, 0, "user", "b")] + [(5, 0, "user", "a"), (5, 1, "assistant", "x")] + [(None, 0, None, "lone")]
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("i", F.lit(1)).withColumn("hash", F.lit(2))).collect()}
    assert set(got) == {2, 4, 5, None}
    assert got[2] == (4, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc < |im_end| ><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")


def test_surrogates_keep_form_and_identity(spark):
    rows = [
        (1, "Mail Anna.Smith@Example.com or anna.smith@example.com, call +1 (212) 555-7713.", 1), (2, "Call (212) 555-7713 or 212-555-7713; card 4111 1111 1111 1111, ip 10.0.0.1.", 1),
        (3, "Mrs. Anna Smith met Herr Müller. token = \"f3ef4d6b2755a36d7d9c25bd72c4\" DE89 3704 0044 0532 0130 00", 1), (4, None, 1), (5, "", 1), (6, "nothing here, version 1.2.3 of 2024", 1), (None, "mail Anna.Smith@Example.com", 1),
    ]
    got = {r.doc_id: r for r in surrogates.replace_pii(documents(spark, rows)).collect()}
    assert got[4].text is None and got[5].text == "" and got[6].text == rows[5][1] and got[6].n_entities == 0
    mails = re.findall(r"\S+@\S+?\.com", got[1].text) + re.findall(r"\S+@\S+?\.com", got[None].text)
    assert mails[0].lower() == mails[1] == mails[2].lower() and mails[0][0].isupper() and "smith" not in got[1].text.lower()
    a, b = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", got[2].text)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "2125557713" and a[0] == "("
    card = re.search(r"card ([\d ]{19})", got[2].text).group(1)
    assert surrogates.luhn(card.replace(" ", "")) and card[0] == "4" and card[4] == " "
    assert re.match(r"Mrs\. [A-Z]\w+ [A-Z]\w+ met Herr [A-Z]\w+\. token = \"[0-9a-f]{28}\" DE\d\d \d{4}", got[3].text)
    assert re.search(r"Mrs\. (\w+)", got[3].text).group(1) in surrogates.GIVEN["female"]


def test_surrogates_that_meet_are_drawn_again(spark):
    known = spark.createDataFrame([("SSN", f"9000000{k:02d}") for k in range(60)] + [("PHONE", f"1{k:03d}") for k in range(60)], "kind string, entity string")
    moved = surrogates.tried(known)
    tries = {(r.kind, r.entity): r.attempt for r in moved.collect()}
    new = [surrogates.surrogate("PHONE", f"1{k:03d}", tries.get(("PHONE", f"1{k:03d}"), 0), surrogates.KEY) for k in range(60)]
    assert tries and len(set(new)) == len(new)
    assert not set(new) & {f"1{k:03d}" for k in range(60)}


def test_mentions_without_anything_to_replace_stay(spark):
    texts = ["Password: ______________", "key = ----------------", "mail ____@____.com", "sk-______________________", "Dr. Հակոբյան came", "mail ա@բ.com"]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in surrogates.replace_pii(documents(spark, rows)).collect()}
    assert [got[k].text for k in range(4)] == texts[:4] and [got[k].n_entities for k in range(4)] == [0] * 4
    assert [got[k].n_entities for k in (4, 5)] == [1, 1] and re.fullmatch(r"Dr\. [Ա-Ֆ][ա-ֆև]{7,} came", got[4].text)
    assert "Հակոբյան" not in got[4].text and "ա@բ" not in got[5].text


@pytest.mark.parametrize("kind, entities", [
    ("PERSON", [f"dr {a}{b}{c}" for a in surrogates.SYLLABLES for b in surrogates.SYLLABLES for c in surrogates.SYLLABLES] + ["dr smith"]),
    ("EMAIL", [f"{a}@b.com" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "acdefghijklmnopqrstuvwxyz"]),
    ("PHONE", [f"1{k}" for k in range(10)]),
])
def test_forms_never_run_out(spark, kind, entities):
    moved = surrogates.tried(spark.createDataFrame([(kind, e) for e in entities], "kind string, entity string"))
    tries = {r.entity: r.attempt for r in moved.collect()}
    new = [surrogates.surrogate(kind, e, tries.get(e, 0), surrogates.KEY) for e in entities]
    assert len(set(new)) == len(new) and not set(new) & set(entities)
    written = [surrogates.formatted(kind, e if kind != "PERSON" else e.title(), x) for e, x in zip(entities, new, strict=True)]
    assert len(set(written)) == len(written)


def test_a_title_is_one_with_or_without_its_dot(spark):
    rows = [(1, "Dr. Smith met Dr Smith, and DR SMITH is none. Mrs Anna Smith, Mrs. Anna Smith.", 1)]
    names = re.findall(r"(Dr|Mrs)(\.?) ([A-Z]\w+(?: [A-Z]\w+)?)", surrogates.replace_pii(documents(spark, rows)).collect()[0].text)
    assert [n[:2] for n in names] == [("Dr", "."), ("Dr", ""), ("Mrs", ""), ("Mrs", ".")]
    assert names[0][2] == names[1][2] != "Smith" and names[2][2] == names[3][2] != "Anna Smith"


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "en", str(s), 1) for i, t, s in some_rows(9, 80) if i is not None and i < 900] + [(990, None, "en", "0", 1), (991, "12 !", "en", "0", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    a = stages[0](spark, docs, str(tmp_path))
    letters = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted(r.doc_id for r in a.collect()) == sorted(r[0] for r in letters) and a.columns == docs.columns
    b = stages[1](spark, a, str(tmp_path))
    first = {}
    for r in sorted(letters, key=lambda r: (-len(r[1]), r[0])):
        first.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1]), r)
    assert sorted(r.doc_id for r in b.collect()) == sorted(r[0] for r in first.values()) and b.columns == docs.columns
    c = stages[2](spark, b, str(tmp_path))
    left = [(r[0], r[1], r[3]) for r in first.values()]
    assert sorted(r.doc_id for r in c.collect()) == sorted({x[2] for x in brute_components(left)}) and c.columns == docs.columns
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} <= {r.doc_id for r in c.collect()}
    per = defaultdict(int)
    for r in whole:
        per[r.sequence_id] += r.length
    assert max(per.values()) <= 2048


def test_tables_of_a_stage_go_when_the_next_begins(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = spark.range(5)
    with common.making(corpus_pipeline.tables_of(spark, rows, 1)):
        first = common.stored(rows, "first")
    with common.making(corpus_pipeline.tables_of(spark, first, 2)):  # the next stage's documents still read it
        second = common.stored(first, "second")
    assert first.count() == 5
    corpus_pipeline.tables_of(spark, rows, 1)  # another pipeline begins: what isn't its own stays
    assert second.count() == 5
    with common.making(corpus_pipeline.tables_of(spark, rows, 2)):
        third = common.stored(rows, "third")
    path = spark._jvm.org.apache.hadoop.fs.Path(common.folders(third).pop())
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path) and second.count() == 5
    corpus_pipeline.tables_of(spark, rows, 3)
    assert not files.exists(path) and second.count() == 5 and common._MAKING == []


def test_workers_drop_what_another_operator_left(spark):
    common.ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= common.BATCH_ROWS
    tokens._powers(1000)
    common.release(keep=True)
    assert len(tokens._POWERS[0]) >= 1000
    common.release()
    assert len(tokens._POWERS[0]) == 1 and tokens.encoder.cache_info().currsize == 0
    assert (tokens._powers(3)[0] * tokens._powers(3)[1] == 1).all()


def test_warc_records_of_other_types(spark, tmp_path):
    """A package as others write it: an info record, requests without a digest, a gzipped index that doesn't know all."""
    block = b"software: x\r\n"
    plain = lambda kind, body: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    records = [plain("warcinfo", block), plain("request", b"GET / HTTP/1.1\r\n\r\n"), warc_zip.warc_record(5, 0, "u", b"body", None), plain("metadata", b"")]
    packed = [gzip.compress(r) for r in records]
    lines, at = [" CDX header"], 0
    for r in packed:
        lines.append('x 2024 {"filename": "data.warc.gz", "offset": "%d", "length": "%d"}' % (at, len(r)))
        at += len(r)
    lines.append('x 2024 {"filename": "elsewhere.warc.gz", "offset": "0", "length": "1"}')
    for name, index in (("a.zip", True), ("b.zip", False)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("archive/data.warc.gz", b"".join(packed))
            if index:
                z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()))
    packages = spark.createDataFrame([((tmp_path / n).as_uri(), 1000) for n in ("a.zip", "b.zip")], "path string, bytes long")
    got = Counter((r.record_type, r.page_id, r.payload_bytes, r.stated_digest is None) for r in warc_zip.read_packages(packages).collect())
    assert got == Counter({("warcinfo", None, len(block), True): 2, ("request", None, 18, True): 2, ("response", 5, 4, False): 2, ("metadata", None, 0, True): 2})


def test_long_addresses_leave_nothing_behind():
    long = "a" * 80 + "." + "b" * 70
    text = f"x {long}@mail.example.org, @ y@z .q@w.org ..r.s@t.example @@u@v.com"
    found = [text[a:b] for a, b, kind in surrogates._mentions(text) if kind == "EMAIL"]
    assert found == [f"{long}@mail.example.org", "q@w.org", "r.s@t.example", "u@v.com"]


def test_shuffle_files_go_when_a_table_is_written(spark):
    from skein.llm import common

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with common.freeing(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
    assert common.stored(spark.range(100).groupBy("id").count(), "cut").count() == 100
