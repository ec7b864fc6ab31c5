"""Main text of web pages by consensus of their hosts.

A first pass over the pages scores every container of each (text outside links and boilerplate, how dense it is, what
its tag and classes say) and gives votes to those near the page's best, under a path of tags and generalised classes.
Spark sums the votes of a host's pages; its winning path is what a second pass extracts. Where a page has no such
container, or one without text, its own best container counts.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, many_to_one, ship, table, tidy

# Elements of HTML by what they do to the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SKIPPED = frozenset("script style title textarea iframe noembed noframes head noscript template svg button select object canvas audio video nav aside footer dialog menu datalist".split())
CONTAINERS = frozenset("article body center dd details div fieldset form li main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open element, unless one of the second set stands between.
ENDS = {"li": ("li", "ul ol menu".split()), "dt": ("dt dd", ["dl"]), "dd": ("dt dd", ["dl"]), "tr": ("tr", ["table"]), "td": ("td th", ["tr", "table"]), "th": ("td th", ["tr", "table"]), "option": ("option", ["select"])}
P_WALLS = frozenset("table td th caption object button template".split())
# Words of classes, ids and roles.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs consent contentinfo complementary cookie cookies disclaimer footer form gdpr header login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription taboola toolbar alert alertdialog dialog".split()
)
#: These hold articles of others, or of readers: an article within doesn't make them content.
FOREIGN = frozenset("comment comments commentlist disqus promo promotion recommended recommendations related replies respond teaser teasers trending".split())
CONTENT = frozenset("article articlebody body content entry main post story text".split())

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LAYOUT = re.compile(r"(?:has|with|no|without|is)[-_]")
HARD, SOFT, HEAD = 1, 2, 3  # why a node isn't content: for good; unless it holds an article; but for its headings
LEAST_VOTE, FULL_VOTE = 500, 1000


class Block(NamedTuple):
    node: int
    text: str
    plain: int  # characters outside links


class Page:
    """Nodes of a page in order: parent, hash of the path, tag, reason for not being content; and its blocks of text."""

    def __init__(self, source: str):
        # Node 0 is the body, with or without its tag.
        self.parent, self.path, self.tag, self.out, self.weight = [-1], [0], ["body"], [0], [0.6]
        self._open: list[tuple[str, int]] = [("body", 0)]
        self._count: dict[str, int] = {}
        self._pieces: list[tuple[int, str, bool]] = []  # node, source, within a link
        self._raw: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self._read(source)
        self._flush()
        for k in range(1, len(self.out)):  # parents stand before their children
            above = self.out[self.parent[k]]
            if above == HARD or above == SOFT:
                self.out[k] = HARD
            elif above == HEAD and self.out[k] == 0 and self.tag[k] not in HEADINGS:
                self.out[k] = HEAD
        self.blocks = [b for b in map(self._block, self._raw) if b]
        self._raw.clear()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = TAG.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._end(name)
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            self._start(name, found[3] or found[6] or "")

    def _text(self, text: str) -> None:
        self._pieces.append((self._open[-1][1], text, self._count.get("a", 0) > 0))

    def _flush(self) -> None:
        if self._pieces:
            self._raw.append((self._owner(), self._pieces))
            self._pieces = []

    def _owner(self) -> int:
        return next(node for tag, node in reversed(self._open) if tag in BLOCKS)

    def _pop(self, depth: int) -> None:
        for tag, _ in self._open[depth:]:
            self._count[tag] -= 1
        del self._open[depth:]

    def _close(self, names, walls) -> None:
        if any(self._count.get(x) for x in names):
            for depth in range(len(self._open) - 1, 0, -1):
                tag = self._open[depth][0]
                if tag in names:
                    self._pop(depth)
                    return
                if tag in walls:
                    return

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name == "wbr":
            self._pieces.append((self._open[-1][1], " " if name == "br" else "", False))
            return
        if name in BLOCKS:
            self._flush()
            self._close(("p",), P_WALLS)
            if name in ENDS:
                names, walls = ENDS[name]
                self._close(names.split(), walls)
        if name == "body":
            self._close(("head",), ())
        if name in VOID or name in ("html", "body"):
            return
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip("/ ") else {}
        node = self._open[-1][1]
        if name in BLOCKS or name in SKIPPED or found:
            node = self._node(name, found, node)
        self._open.append((name, node))
        self._count[name] = self._count.get(name, 0) + 1

    def _node(self, name: str, found: dict[str, str], parent: int) -> int:
        tokens = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')} {found.get('itemprop', '')}".split()
        words = {w.lower() for t in tokens if not LAYOUT.match(t) for w in WORD.findall(t)}
        classes = sorted({re.sub(r"\d+", "#", t.lower()) for t in found.get("class", "").split()})
        step, before = ".".join([name, *classes]), self.path[parent]
        self.parent.append(parent)
        self.tag.append(name)
        self.path.append(zlib.crc32(step.encode("utf-8", "replace"), before >> 32) << 32 | zlib.crc32(f">{step}".encode("utf-8", "replace"), before & 0xFFFFFFFF))
        self.out.append(self._reason(name, found, words, parent))
        self.weight.append(3.0 if name == "article" else 2.5 if name == "main" or "main" in words else 2.0 if words & CONTENT else 1.0)
        if (name in ("article", "main", "h1") or "main" in words) and not self.out[-1]:
            above = parent
            while above > 0:  # what holds an article is no boilerplate by its class alone, nor is a form with a headline
                if self.out[above] == SOFT and (name != "h1" or self.tag[above] == "form"):
                    self.out[above] = 0
                above = self.parent[above]
        return len(self.tag) - 1

    def _reason(self, name: str, found: dict[str, str], words: set[str], parent: int) -> int:
        if name == "main":
            return 0
        if name in SKIPPED or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
            return HARD
        if words & FOREIGN:
            return HARD
        if name == "article":
            return 0
        if name == "header" or "header" in words:
            return HEAD if self._count.get("article") or self._count.get("main") or words & CONTENT else HARD if name == "header" else SOFT
        return SOFT if name == "form" or words & BOILERPLATE else 0

    def _end(self, name: str) -> None:
        if name == "br":
            self._pieces.append((self._open[-1][1], " ", False))
            return
        if name in ("body", "html"):
            return
        if name in BLOCKS:
            self._flush()
        if not self._count.get(name):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self._open[depth][0]
            if tag == name:
                if name in BLOCKS or name in SKIPPED or not any(t in BLOCKS for t, _ in self._open[depth:]):
                    self._pop(depth)
                else:  # a block stands open within an inline element: it stays open
                    self._count[name] -= 1
                    del self._open[depth]
                return
            if tag in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return

    def _block(self, raw: tuple[int, list[tuple[int, str, bool]]]) -> Block | None:
        node, pieces = raw
        held = [(t, link) for k, t, link in pieces if not self.out[k]]
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        return Block(node, text, sum(len(t) for t, link in held if not link)) if text else None

    def scores(self) -> list[float]:
        """Of each node: characters outside links, times their share of all within, times what tag and classes say."""
        plain, every = [0] * len(self.tag), [0] * len(self.tag)
        for node, text, outside in self.blocks:
            plain[node] += min(outside, len(text))
            every[node] += len(text)
        for k in range(len(self.tag) - 1, 0, -1):
            plain[self.parent[k]] += plain[k]
            every[self.parent[k]] += every[k]
        return [p * p / e * w if e and not o and t in CONTAINERS else 0.0 for p, e, w, o, t in zip(plain, every, self.weight, self.out, self.tag)]

    def votes(self) -> dict[int, int]:
        """Path to votes: FULL_VOTE for the best container, less for those that come near it."""
        scores = self.scores()
        best, out = max(scores), {}
        for path, score in zip(self.path, scores):
            if best and (vote := int(FULL_VOTE * score / best)) >= LEAST_VOTE:
                out[path] = max(vote, out.get(path, 0))
        return out

    def text(self, path: int | None) -> str:
        """The blocks within the containers of this path, in page order; without any text there, those of the page's best
        container; of a page without containers, all."""
        text = self._within([p == path and not o for p, o in zip(self.path, self.out)]) if path is not None else ""
        if not text:
            scores = self.scores()
            best = scores.index(max(scores))
            text = self._within([k == best for k in range(len(scores))])
        return text

    def _within(self, chosen: list[bool]) -> str:
        for k in range(1, len(chosen)):
            chosen[k] = chosen[k] or chosen[self.parent[k]]
        return "\n\n".join(b.text for b in self.blocks if chosen[b.node])


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null for what has none."""
    host = F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def signed(path: int) -> int:
    return path - (1 << 64) if path >= 1 << 63 else path


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host: host, path (a 64-bit hash), votes. Pages without a host take no part.

    A task sums the votes of a batch before they are shuffled, and Spark those of a task, so that a host with a third of
    all pages is a few rows for each path. Ties go to the smaller hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], int] = {}
            for host, source in zip(batch.column(0), batch.column(1)):
                name = host.as_py()
                for path, votes in Page(source.as_py()).votes().items():
                    sums[name, path] = sums.get((name, path), 0) + votes
            hosts, paths = [h for h, _ in sums], [signed(p) for _, p in sums]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "votes"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).where("host IS NOT NULL")
    votes = rows.mapInArrow(tidy(run), "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", (-F.col("path")).alias("low"))).alias("w")).select("host", (-F.col("w.low")).alias("path"), "w.votes")


#: A table of hosts and paths of at most so many bytes goes to all executors; a larger one is joined, hot hosts by salts.
BROADCAST_BYTES = 8 << 20


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (blocks joined by two line feeds, empty if none) and n_chars (its code points).

    Null and empty pages have an empty text; pages whose url has no host are judged by themselves; repeated rows each get
    their text and vote; an empty table gives an empty result; other columns are left aside.
    """
    ship(pages.sparkSession)
    winners = cut(host_paths(pages, url_col, html_col)).select("host", "path")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    size = winners.agg(F.sum(F.octet_length("host") + 24)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        joined = many_to_one(rows, winners, ["host"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path in zip(batch.column(2), batch.column(3)):
                chosen = path.as_py()
                texts.append(Page(source.as_py()).text(None if chosen is None else chosen % (1 << 64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
