"""Operator 4: main text of web pages by consensus paths of their hosts.

Every page scores its containers and votes for the path of the best one, written as tags with generalised classes.
Spark counts the votes of each host; pages are then read again and the text under the host's winning path is taken. A
page without that path, or with no text under it, goes by the host's next paths and last by its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import written
from tidemark.llm.units import small_batches
from tidemark.llm.urls import host_of

#: Paths of a host that are tried, in order of their votes.
PATHS = 5
#: Winning paths are broadcast for up to so many hosts, in rows of fixed size: a host's hash and PATHS hashes of paths.
#: Beyond that they join by host and salt.
BROADCAST_ROWS, SALTS = 100_000, 64

_TAG = re.compile(r"/?([a-z][a-z0-9:-]*)", re.I)
_STOP = re.compile("[>\"']")
#: Elements whose content is no markup, or not the page's.
RAW = frozenset("script style noscript template textarea svg iframe title select button".split())
#: Those whose content runs to their end tag, whatever it holds; of the others the next tag of their name counts.
TEXT_ONLY = frozenset(("script", "style"))
_RAW_END = {tag: re.compile(rf"</{tag}\s*>" if tag in TEXT_ONLY else rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTRIBUTE = {name: re.compile(rf"""(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I) for name in ("class", "id", "role")}
_NAME = re.compile(r"[^a-z]+")
#: Elements that hold other blocks.
CONTAINERS = frozenset("html body main article form section div td th tr tbody thead table ul ol li dl dd dt center blockquote figure details".split())
#: Elements that never belong to the article.
OUTSIDE = frozenset("head nav header footer aside menu dialog fieldset object audio video canvas".split())
#: Elements that end a block but hold no others.
BREAKS = frozenset("p br hr h1 h2 h3 h4 h5 h6 pre address figcaption summary caption legend option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a class, id or role that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer "
    "foot sidebar aside rail widget widgets notice notices cookie cookies consent gdpr alert popup modal newsletter subscribe subscription signup login form search share sharing social related "
    "recommended comment comments commentlist disqus replies reply respond pagination pager toolbar".split()
)
#: Those of them that no amount of text outvotes where every name of an element says so.
FIRM = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter comment comments commentlist disqus replies reply respond".split())
#: A name that begins so tells of the page's state, not of the element ("has-sidebar", "no-header").
STATES = frozenset("has have no not with without is hide hides show shows".split())
#: A name that ends so is the article's ("social-article"), unless one of these says that it only points to one.
HEADS, POINTERS = frozenset("article main story entry".split()), frozenset("related recommended sponsored sponsor promo promotion comment comments reply ad ads".split())
#: These are never set aside for their class alone.
KEPT = frozenset("html body main article".split())
#: What a container's name adds to its score.
LIKELY = {"article": 1.5, "main": 1.3}


def _values(attributes: str, name: str) -> list[str]:
    return [m[1] or m[2] or m[3] or "" for m in _ATTRIBUTE[name].finditer(attributes)]


def _marks(attributes: str) -> int:
    """Whether a class, id or role says that the element is no part of the article: 0 no, 1 yes, 2 firmly, as all of them say so."""
    marked, firm = False, True
    for kind in _ATTRIBUTE:
        for value in _values(attributes, kind):
            for name in value.lower().split():
                parts = [x for x in _NAME.split(name) if x]
                if parts and not MARKS.isdisjoint(parts) and parts[0] not in STATES and (parts[-1] not in HEADS or not POINTERS.isdisjoint(parts)):
                    marked, firm = True, firm and not FIRM.isdisjoint(parts)
                elif parts:
                    firm = False
    return marked + (marked and firm)


def tags(source: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name and attributes of every tag; name is "/x" for an end tag, empty for a comment, declaration or raw element.

    A raw element that is not closed before the next of its kind, or not at all, is an ordinary one; so is what it
    holds. An unclosed script or style takes the rest.

    One pass: a quoted value may hold ">", and a tag with an unclosed quote ends at its first ">". Quotes from which
    no end was found are remembered, so that no part of the source is searched again and again. What no ">" follows
    is text.
    """
    last, dead, unclosed, at = source.rfind(">"), set(), set(), 0
    while True:
        at = source.find("<", at)
        if at < 0 or at > last and not source.startswith("<!--", at):
            return
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, "", ""
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
            yield at, end, "", ""
        elif m := _TAG.match(source, at + 1):
            end, opened, i = -1, [], m.end()
            while i <= last and (found := _STOP.search(source, i)):
                i = found.start()
                if source[i] == ">":
                    end = i + 1
                    break
                if i in dead:
                    break
                opened.append(i)
                close = source.find(source[i], i + 1)
                if close < 0:
                    break
                i = close + 1
            if end < 0:
                dead.update(opened)
                end = source.find(">", m.end()) + 1
                if not end:
                    return
            name = m[1].lower()
            if source[at + 1] == "/":
                yield at, end, "/" + name, ""
            elif name in RAW and not (name == "svg" and source[end - 2] == "/"):
                closing = None if name in unclosed else _RAW_END[name].search(source, end)
                if closing is None and name not in TEXT_ONLY:
                    unclosed.add(name)
                if closing is None and name in TEXT_ONLY or closing and (name in TEXT_ONLY or closing[1]):
                    end = closing.end() if closing else len(source)
                    yield at, end, "", ""
                else:  # it has no end tag of its own: it ends with its parent
                    yield at, end, name, source[m.end() : end - 1]
            else:
                yield at, end, name, source[m.end() : end - 1]
        else:
            end = at + 1
        at = end


class Page:
    """One reading of a page: its blocks of text with the containers that they lie in.

    A container's path is a hash of its parent's path and of its own tag and generalised classes: their letters, in
    order. A container is set aside for its class, id or role, as a form is, but stays in if it holds main, or an
    article that is not itself set aside, and does not hold comments. On a page without either, content outvotes
    marks: a container with more than half of the page's text outside links, not counting what lies in others that
    are marked, stays in as well, unless all its names are of adverts, notices or comments.
    """

    def __init__(self, source: str):
        self.paths: list[str] = []  # of the containers, in page order
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.away: list[bool] = []
        self.firm: list[bool] = []
        self.has_article = False
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._read(source)
        if not self.has_article:
            self._outvote()
        for i, parent in enumerate(self.parents):
            self.away[i] |= parent >= 0 and self.away[parent]
        self.blocks = [b for b in self.blocks if b[0] < 0 or not self.away[b[0]]]

    def _open(self, tag: str, attributes: str, parent: int, comments: bool) -> int:
        names = sorted({n for value in _values(attributes, "class") for n in _NAME.split(value.lower()) if n}) if "=" in attributes else []
        above = self.paths[parent] if parent >= 0 else ""
        self.paths.append(xxhash.xxh3_128_hexdigest(f"{above}>{'.'.join([tag, *names])}"))
        self.tags.append(tag)
        self.parents.append(parent)
        marked = _marks(attributes) if "=" in attributes else 0
        self.away.append((marked > 0 or tag == "form") and tag not in KEPT)
        self.firm.append(marked == 2)
        if (tag == "main" or tag == "article" and not marked) and not comments:
            self.has_article = True
            at = parent
            while at >= 0 and self.away[at]:
                self.away[at] = False
                at = self.parents[at]
        return len(self.paths) - 1

    def _outvote(self) -> None:
        """Takes marked containers back that hold most of the page's text outside links, with those around them."""
        nearest, own, whole = [], [0] * len(self.tags), 0
        for i, parent in enumerate(self.parents):
            nearest.append(i if self.away[i] else nearest[parent] if parent >= 0 else -1)
        for at, text, linked in self.blocks:
            worth = max(0, len(text) - linked)
            whole += worth
            if at >= 0 and nearest[at] >= 0:
                own[nearest[at]] += worth
        if not own or 2 * max(own) <= whole:
            return
        at = own.index(max(own))
        if not self.firm[at]:
            while at >= 0:
                self.away[at] = False
                at = self.parents[at]

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = []  # tag, container, whether it is outside the article, whether it holds comments
        held: Counter[str] = Counter()
        current, outside, comments, links, linked = -1, 0, 0, 0, 0
        text: list[str] = []

        def flush() -> None:
            nonlocal linked
            if text:
                words = html.unescape("".join(text)).split()
                if words:
                    self.blocks.append((current, " ".join(words), linked))
                text.clear()
            linked = 0

        def leave(to: int) -> None:
            nonlocal current, outside, comments
            flush()
            while len(stack) > to:
                tag, _, was_outside, had_comments = stack.pop()
                held[tag] -= 1
                outside -= was_outside
                comments -= had_comments
            current = stack[-1][1] if stack else -1

        def enter(tag: str, is_outside: bool, has_comments: bool = False) -> None:
            nonlocal outside, comments
            stack.append((tag, current, is_outside, has_comments))
            held[tag] += 1
            outside += is_outside
            comments += has_comments

        at = 0
        for start, end, tag, attributes in tags(source):
            if not outside and start > at:
                piece = source[at:start]
                text.append(piece)
                if links:
                    linked += len(piece)
            at = end
            if not tag:
                continue
            if tag[0] == "/":
                tag = tag[1:]
                if tag == "a":
                    links = max(0, links - 1)
                elif held[tag] > 0:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            leave(i)
                            break
                elif tag in BREAKS and tag not in ("option", "legend") and stack and stack[-1][0] in RAW:
                    leave(len(stack) - 1)  # the element was opened in the block that ends here
                elif tag in CONTAINERS or tag in OUTSIDE or tag in BREAKS:
                    flush()
                continue
            block = tag in CONTAINERS or tag in OUTSIDE or tag in BREAKS
            if block:
                if stack and stack[-1][0] in BREAKS:
                    leave(len(stack) - 1)
                elif tag in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == tag:
                    leave(len(stack) - 1)
                else:
                    flush()
            if tag == "a":
                links += 1
            if tag in VOID or attributes.endswith("/") and tag not in CONTAINERS:
                continue
            if outside:
                if block and tag not in BREAKS or tag in RAW:
                    enter(tag, tag in OUTSIDE or tag in RAW)
            elif tag in RAW:
                text.append(" ")
                enter(tag, True)
            elif tag in CONTAINERS or not block and "=" in attributes and _marks(attributes):
                if not block:
                    flush()
                current = self._open(tag, attributes, current, comments > 0)
                enter(tag, False, self.away[current] and "comment" in attributes.lower())
            elif tag in OUTSIDE or "=" in attributes and _marks(attributes):
                enter(tag, True)
        if not outside:
            text.append(source[at:])
        flush()

    def best(self) -> int:
        """The container that scores highest: its own blocks' text outside links, half of its children's, a quarter of theirs; the first of equals."""
        score = [0.0] * len(self.paths)
        for at, text, linked in self.blocks:
            worth = max(0.0, len(text) - 3.0 * linked)
            for _ in range(3):
                if at < 0:
                    break
                score[at] += worth
                at, worth = self.parents[at], worth / 2
        for i, tag in enumerate(self.tags):
            score[i] *= LIKELY.get(tag, 1.0)
        return max(range(len(score)), key=lambda i: (score[i], -i)) if score and max(score) > 0 else -1

    def under(self, wanted: set[int]) -> str:
        """The blocks in the wanted containers or below them."""
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):
            inside[i] = i in wanted or parent >= 0 and inside[parent]
        return " ".join(text for at, text, _ in self.blocks if at >= 0 and inside[at])

    def main_text(self, winners: list[str]) -> str:
        for path in winners:
            if text := self.under({i for i, p in enumerate(self.paths) if p == path}):
                return text
        own = self.best()
        return self.under({own}) if own >= 0 else " ".join(text for _, text, _ in self.blocks)


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host (a hash of it), path (a hash, see `Page`) and votes: rows of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = [], []
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source)
                if (i := page.best()) >= 0:
                    hosts.append(host)
                    paths.append(page.paths[i])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(paths, pa.string())], ["host", "path"])

    rows = pages.where(F.length(html_col) > 0).select(F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "host long, path string").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(counted: DataFrame, most: int = PATHS) -> DataFrame:
    """host and its paths with most votes, in order; equal votes by path."""
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("k") <= most)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`id_col`, `url_col`, text and n_chars (code points) of every page's main text.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out wherever
    they stand. A block's white space becomes one space; blocks are joined by one space. Null or empty html gives the
    empty text. Hosts are those of `urls.host_of`; pages without one vote together. Null and repeated ids and rows
    come out as they came in; other columns are not read.
    """
    small_batches(pages)
    won = written(winners(votes(pages, url_col, html_col)), "winners")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(host_of(F.col(url_col))).alias("host"))
    if won.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [Page(source).main_text(paths or []) if source else "" for source, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["id", "url", "text", "n_chars"])

    done = rows.select("id", "url", "html", "paths").mapInArrow(run, "id long, url string, text string, n_chars long")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
