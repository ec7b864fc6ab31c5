"""Filter audit, importance resampling and main text of pages, against plain code on small fixtures."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from skein.llm import filter_audit, importance, main_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def documents(spark, rows):
    full = [(i, t, None, s, 7) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).select("*", F.lit(1).alias("part"), F.lit("x").alias("pattern"), F.lit(2).alias("rank"), F.lit(3).alias("score"), F.lit(4).alias("size"), F.lit(5).alias("id"))


def fixture(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)] + ["ABC", "#tag", "a|b", "é", "漢字", "x\x00y"]
    rows = []
    for k in range(90):
        n = rng.choice([0, 1, 10, 19, 20, 21, 49, 50, 51, 80, 200])
        few = words[: rng.choice([10, 40, 126])]
        rows.append((k, " ".join(rng.choice(few) for _ in range(n)), rng.choice(["a", "b", None, ""])))
    rows += [(100 + k, rows[k % 9][1], "c") for k in range(30)]
    long = " ".join(rng.choice(words) for _ in range(30000))
    return rows + [(300, None, "a"), (301, "", None), (302, long, "a"), (303, long, "a"), (None, long, "b"), (None, "only null", "b"), (304, "A" * 400, "b"), (304, "A" * 400, "b"), (304, "other", "b")]


def brute_audit(rows, labels):
    texts = [(i, t or "", s or "") for i, t, s in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}  # a null id has no labels
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        w = WORD.findall(t)
        smaller = any(u == t and j is not None and (i is None or j < i) for j, u, _ in texts)
        bits = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(re.search("[#$%&*|]", t)), smaller)
        return {f for f, b in zip("ABCDE", bits) if b}

    all_ = [(i, p, fails(i, t)) for i, t, p in texts]
    out, removals = {}, Counter()
    for part in {p for _, p, _ in all_}:
        mine = [(i, f) for i, p, f in all_ if p == part]
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                open_ = [(i, f) for i, f in mine if not f & before]
                gone = [i for i, f in open_ if own in f]
                out[part, "".join(order), step] = [
                    len(open_) - len(gone), len(gone), sum(1 for _, f in mine if own in f and f & before), sum(1 for _, f in mine if f == {own}),
                    sum(1 for i in gone if i in good), sum(1 for i in gone if i in toxic),
                ]
                removals[part, own] += len(gone)
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_against_brute_force(spark):
    rows = fixture()
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (302, 1, 0), (9999, 1, 1)]
    got = filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 4 * 600  # parts a, b, c and the empty one
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got} == want


def test_filter_audit_of_an_empty_table(spark):
    none = documents(spark, [(1, "x", "a")]).where("doc_id = 2")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    alone = filter_audit.audit(documents(spark, [(1, "x", "a")]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert alone.count() == 600 and alone.where("good_lost + toxic_lost > 0").count() == 0


def grams(text, least, most):
    w = SPLIT.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[k : k + n]) for n in range(least, most + 1) for k in range(len(w) - n + 1)]


def brute_resample(rows, target, least, most, buckets):
    feats = [grams(t, least, most) for _, t, _ in rows]
    hist = lambda lists: Counter(zlib.crc32(g.encode()) % buckets for fs in lists for g in fs)
    s, t = hist(f for _, f in feats), hist(grams(x, least, most)[1] for x in target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (i, _, _), (n, fs) in zip(rows, feats):
        weight = sum(gain(zlib.crc32(g.encode()) % buckets) for g in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((k for k, r in enumerate(out) if r[1] >= 20), key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0))
    ranks = {k: place for place, k in enumerate(open_[: len(open_) * 10 // 100], 1)}
    return sorted(((r[0], *r[2:], ranks.get(k)) for k, r in enumerate(out)), key=str)


@pytest.mark.parametrize("least,most,buckets,slice_chars", [(1, 1, 10000, 1 << 18), (1, 2, 97, 50), (2, 3, 70000, 7)])
def test_resampling_against_brute_force(spark, monkeypatch, least, most, buckets, slice_chars):
    monkeypatch.setattr(importance, "SLICE_CHARS", slice_chars)
    rows = fixture() + [(400, "Ä1-b_c  ÉÈ\tÀ", "a"), (401, "ONE two THREE " * 30, "a")]
    target = ["w1 w2 w3 w4 w1 w1 w2", None, "", "漢字 three ONE"]
    if slice_chars < 1 << 18:  # the setting is the driver's: short slices are tried on the class itself
        split = importance.Splitter(least, most, buckets)
        for _, t, _ in rows:
            n, fs = grams(t, least, most)
            got_n, found = split.features((t or "").translate(LOWER))
            assert got_n == n and Counter(found.tolist()) == Counter(zlib.crc32(g.encode()) % buckets for g in fs)
    got = importance.resample(documents(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), least, most, buckets)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, least, most, buckets)


def test_resampling_of_empty_tables(spark):
    rows = documents(spark, [(k, "word " * 30, "a") for k in range(30)])
    nothing = spark.createDataFrame([], "text string")
    got = importance.resample(rows, nothing).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert importance.resample(rows.where("doc_id < 0"), nothing).count() == 0


def test_places_in_the_order_of_all(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("v"), F.lit(1).alias("same")).repartition(11)
    got = importance.placed(df, [F.col("v").desc()], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 3001)) and [r.v for r in got] == sorted((k % 7 for k in range(3000)), reverse=True)


def page(body, classes="post post-12"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="{classes}">{body}</body></html>'


ARTICLE = "<header><h1>Head &amp; line</h1><p>by line</p></header><p>First  para<br>goes\non &lt;here&gt;</p><ul><li>one<li>two</ul><div class='ad-slot'>buy</div><p>Second <b>bold</b> para.</p>"


def test_one_page():
    wrap = f"<div id='cookie-notice'>cookies</div><header>site</header><nav>menu</nav><div class='layout with-sidebar'><article class='post-7'>{ARTICLE}<form>send</form><section id='comments'><article class='comment'><p>{'nice ' * 80}</p></article></section><footer>end</footer></article><aside>{'side ' * 90}</aside></div><footer>bye</footer>"
    want = "Head & line\n\nFirst para goes on <here>\n\none\n\ntwo\n\nSecond bold para."
    assert main_text.Page(page(wrap)).text(None) == want
    assert main_text.Page(page(wrap)[:-20]).text(None) == want  # cut off
    for source in ("", "<p>", "<!-- x", "<script>x", "&nbsp; &#32;"):
        assert main_text.Page(source).text(None) == ""
    assert main_text.Page("a < b <3 <p>x &lt; y").text(None) == "a < b <3\n\nx < y"
    assert main_text.Page("<form id=f><div id=main><p>kept</p></div></form>").text(None) == "kept"
    assert main_text.Page("<div>" * 20000 + "deep").text(None) == "deep"
    assert main_text.Page("<b>" * 3000 + "<p>z" * 300).text(None).count("z") == 300


def test_hosts_agree(spark):
    """A page on which other text outweighs the article has it by the votes of its host; one of another shape by itself."""
    usual = [(k, f"https://Site.example.org:443/{k}", page(f"<div class='box'><div class='story-{k}'><p>{'good text ' * 40}{k}</p></div><div class='extra'><p>{'more ' * 10}</p></div></div>")) for k in range(12)]
    odd = (50, "http://site.example.org/odd", page(f"<div class='box'><div class='story-50'><p>short but right</p></div><div class='extra'><p>{'more ' * 300}</p></div></div>"))
    other = (51, "//u@site.example.org/x", page("<article><p>another shape</p></article>"))
    lone = [(60, None, page("<p>alone</p>")), (61, "no host", None), (61, "no host", ""), (None, "http://[x", "<p>q</p>")]
    rows = spark.createDataFrame([*usual, odd, other, *lone], "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("path"), F.lit(3).alias("text"), F.lit(4).alias("n_chars"))
    got = {r.page_id: r for r in main_text.main_text(rows).collect()}
    assert got[50].text == "short but right" and got[51].text == "another shape" and got[3].text.endswith("good text 3")
    assert main_text.Page(odd[2]).text(None) != "short but right"  # by itself it would fail
    assert got[60].text == "alone" and got[61].text == "" and got[61].n_chars == 0 and got[None].text == "q"
    assert len(main_text.main_text(rows).collect()) == 18 and main_text.main_text(rows.where("page_id < 0")).count() == 0
    paths = main_text.host_paths(rows).collect()
    assert [r.host for r in paths if r.host == "site.example.org"] == ["site.example.org"]


def test_hosts_joined_by_salts(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"http://h{k % 3}.example/", page(f"<article><p>text {k}</p></article>")) for k in range(60)], "page_id long, url string, html string")
    monkeypatch.setattr(main_text, "BROADCAST_BYTES", 0)
    monkeypatch.setattr("skein.llm.common.PLAIN_ROWS", 10)
    monkeypatch.setattr("skein.llm.common.LEAST_OFTEN", 5)
    assert {r.page_id: r.text for r in main_text.main_text(rows).collect()} == {k: f"text {k}" for k in range(60)}


def test_pages_of_the_driver_against_their_articles(spark):
    """The generated pages have one article each, of a headline and paragraphs."""
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/pages.parquet").collect()
    got = {r.page_id: r.text for r in main_text.op13_main_text(spark, path).collect()}
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r.html or "", re.S)
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner[1] if inner else "")]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
