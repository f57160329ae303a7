"""Main text of web pages by equivalence-class template deduction.

Structural tokens of a page are its tags and text nodes, each with its path of open elements. Tokens of
one host that occur equally often on every page (equal occurrence vectors) form an equivalence class.
Classes of at least two tokens that occur on nearly all of a host's pages and repeat by the same count
everywhere are its template; classes whose count differs by page (rows of lists) join it where they nest
in it. What the template leaves open are slots, and the main text is what fills the unmarked slots of a
page, of whatever element. Regions that markup names as menus, headers, footers, asides, forms, notices,
adverts or comments are marked, articles among them. An article or main element is a check made
afterwards: one that holds most of the slots' text is taken alone.

Occurrence vectors are never collected: a vector is known by the sum of hashes of its (page, count)
pairs, which Spark sums with partial aggregation. Pages meet their host's template by (host, part of
the host), so that the pages of a host with a third of all are read by many tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import table
from panelloom.llm.url_filter import host_and_path

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
CLASS = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: Fixed lists of HTML elements and of names that mark regions other than the main text.
RAW = frozenset("script style noscript template iframe svg math object embed canvas select textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
OUTSIDE = frozenset("nav footer aside form head dialog menu button fieldset figure-ad".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored sponsor promo promotion banner menu nav navbar navigation topbar sidebar aside footer masthead cookie cookies consent notice notices alert newsletter subscribe "
    "signup popup modal overlay share sharing social related recommended comment comments disqus replies breadcrumb breadcrumbs widget pagination pager toolbar search login skip complementary contentinfo".split()
)
MAIN = frozenset(("article", "main"))
LEAST_PAGES = 3


def nodes(page: str) -> Iterator[tuple[str, str, str]]:
    """('start' | 'end' | 'text', element name, attributes or text) of a page; comments and raw elements go."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "end", name, ""
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else n
            continue
        yield "start", name, attributes
    if at < n:
        yield "text", "", page[at:]


def region(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element opens a region that is no main text; headers of an article belong to it."""
    if name in OUTSIDE or (name == "header" and not inside):
        return True
    if "=" in attributes and name not in ("html", "body", "main"):
        for value in CLASS.findall(attributes):
            if any(word in MARKS for word in re.split(r"[^a-z]+", value.lower())):
                return True
    return False


class Walk:
    """One pass over a page: its structural tokens, and blocks of text with the element they stand in."""

    def __init__(self, page: str) -> None:
        self.tokens: Counter[int] = Counter()
        self.above: dict[int, int] = {}  # token of the element around a token
        self.blocks: list[tuple[str, int, list[int]]] = []  # text, element, text tokens
        # elements by number; 0 is the page
        self.parent, self.is_main, self.marked, self.ended = [-1], [False], [False], [False]
        open_: list[tuple[str, int, int]] = []  # name, number, path hash
        main = 0
        text: list[str] = []
        own: list[int] = []
        for kind, name, rest in nodes(page):
            path = open_[-1][2] if open_ else 0
            if kind == "text":
                text.append(rest)
                if not rest.isspace():
                    token = xxhash.xxh64_intdigest(" ".join(rest.split()), seed=path & 0xFFFFFFFF) | 1
                    own.append(token)
                    self.tokens[token] += 1
                    self.above[token] = path
                continue
            if name not in INLINE:
                self.close(text, own, open_[-1][1] if open_ else 0)
                text, own = [], []
            if kind == "start":
                if name in VOID:
                    continue
                if name == "p" and open_ and open_[-1][0] == "p":
                    open_.pop()
                path = open_[-1][2] if open_ else 0
                token = xxhash.xxh64_intdigest(f"<{name} {' '.join(sorted(CLASS.findall(rest)))}", seed=path & 0xFFFFFFFF) | 1
                self.tokens[token] += 1
                self.above[token] = path
                if name not in INLINE:
                    self.parent.append(open_[-1][1] if open_ else 0)
                    self.is_main.append(name in MAIN)
                    self.marked.append(region(name, rest, main > 0))
                    self.ended.append(False)
                    open_.append((name, len(self.parent) - 1, token))
                    main += name in MAIN
            elif name not in INLINE and any(n == name for n, _, _ in open_):
                while open_:
                    n, number, _ = open_.pop()
                    main -= n in MAIN
                    if n == name:
                        self.ended[number] = True
                        break
        self.close(text, own, open_[-1][1] if open_ else 0)

    def close(self, text: list[str], own: list[int], element: int) -> None:
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = entities.unescape(joined)
            words = joined.split()
            if words:
                self.blocks.append((" ".join(words), element, own))

    def place(self, element: int) -> tuple[bool, int]:
        """Whether an element lies in a marked region, and its outermost article or main element (0: none).

        A marked element left open does not swallow an article or main element below it.
        """
        top = 0
        while element > 0:
            if self.is_main[element] and not self.marked[element]:
                top = element
            if self.marked[element] and (self.ended[element] or not top):
                return True, 0
            element = self.parent[element]
        return False, top


def main_text(page: str, template: frozenset[int]) -> str:
    """Main text of a page, given the hashes of its host's template tokens."""
    walk = Walk(page)
    places = {e: walk.place(e) for e in {b[1] for b in walk.blocks}}
    inside = [b for b in walk.blocks if not places[b[1]][0]]
    # slots are blocks that are not constant text of the template; a page without any repeats the others' text
    slots = [b for b in inside if not b[2] or not all(t in template for t in b[2])] or inside
    size: Counter[int] = Counter()
    for b in slots:
        size[places[b[1]][1]] += len(b[0])
    top = max((e for e in size if e), key=lambda e: size[e], default=0)
    if top and 2 * size[top] >= size.total():
        slots = [b for b in slots if places[b[1]][1] == top]
    return " ".join(b[0] for b in slots)


def _signed(values) -> np.ndarray:
    return np.array([v & 0xFFFFFFFFFFFFFFFF for v in values], np.uint64).view(np.int64)


PARTIAL = "host string, token long, above long, vector long, pages long, least long, most long"
#: Stands for the pages of a host themselves; tokens of pages are odd.
PAGE = 0


def _counter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PARTIAL sums over pages of one batch; those of PAGE have the least and most of the pages' own hashes."""
    for f in frames:
        sums: dict[tuple[str, int], list[int]] = {}
        for page_id, host, page in zip(f["row"], f["host"], f["html"], strict=True):
            walk = Walk(page)
            own = xxhash.xxh64_intdigest(str(sorted(walk.tokens.items()))) >> 1
            s = sums.setdefault((host, PAGE), [0, 0, own, own, 0])
            s[1] += 1
            s[2], s[3] = min(s[2], own), max(s[3], own)
            for token, n in walk.tokens.items():
                s = sums.setdefault((host, token), [0, 0, n, n, walk.above[token]])
                s[0] += xxhash.xxh64_intdigest(f"{page_id}:{n}")
                s[1] += 1
                s[2], s[3] = min(s[2], n), max(s[3], n)
        v = list(sums.values())
        yield pd.DataFrame({
            "host": [k[0] for k in sums], "token": _signed(k[1] for k in sums), "above": _signed(x[4] for x in v), "vector": _signed(x[0] for x in v),
            "pages": [x[1] for x in v], "least": [x[2] for x in v], "most": [x[3] for x in v],
        }, columns=["host", "token", "above", "vector", "pages", "least", "most"])


def _nested(least_share: float):
    """Template of each host: classes of one count, then those all of whose outer tokens stand in the template or in themselves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for classes, of in zip(f["classes"], f["of"], strict=True):
                template: set[int] = set()
                waiting = []
                for c in classes:
                    if c["pages"] < least_share * of:
                        continue
                    if c["even"]:
                        template.update(c["tokens"])
                    else:
                        waiting.append((set(c["tokens"]), set(c["above"])))
                while fits := [c for c in waiting if c[1] - c[0] <= template]:
                    for tokens, _ in fits:
                        template |= tokens
                    waiting = [c for c in waiting if not c[0] <= template]
                out.append(sorted(template))
            yield pd.DataFrame({"host": f["host"], "template": out})

    return run


def templates(pages: DataFrame, least_share: float = 0.8) -> DataFrame:
    """(host, template array<long>): tokens of valid classes of each host, from (row, host, html).

    A class is valid if it has two tokens or more and occurs on ``least_share`` of the host's pages,
    LEAST_PAGES at least, by one count everywhere or nested in such classes, and if the host's pages
    differ at all: from copies of one page nothing can be told apart and the template is empty.
    """
    parts = pages.mapInPandas(_counter, PARTIAL)
    # sums of 64-bit hashes wrap around; halves are summed apart so that no mode of Spark calls it an overflow
    tokens = parts.groupBy("host", "token").agg(
        F.sum(F.shiftrightunsigned("vector", 32)).alias("high"), F.sum(F.col("vector").bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("above").alias("above")
    ).where(F.col("pages") >= LEAST_PAGES)
    classes = tokens.groupBy("host", "high", "low", "pages", "least", "most").agg(F.collect_set("token").alias("tokens"), F.collect_set("above").alias("above"))
    page = F.array_contains("tokens", F.lit(PAGE).cast("long"))
    # classes that repeat over pages are few, whatever the host's size
    found = classes.where(page | (F.size("tokens") >= 2)).groupBy("host").agg(
        F.max(F.when(page, F.col("pages"))).alias("of"), F.max(F.when(page, F.col("least") < F.col("most"))).alias("differ"),
        F.collect_list(F.when(~page, F.struct("tokens", "above", "pages", (F.col("least") == F.col("most")).alias("even")))).alias("classes"),
    )
    return found.where("differ").select("host", "of", "classes").mapInPandas(_nested(least_share), "host string, template array<long>").where(F.size("template") > 0)


#: Hosts are counted by HOST_GROUPS hashes of their names, a bound on what reaches the driver.
HOST_GROUPS = 4096


def with_templates(rows: DataFrame, found: DataFrame, pages_a_part: int = 200) -> DataFrame:
    """``rows`` (host, row, ...) with their host's template or null, joined by parts of at most about ``pages_a_part`` pages."""
    group = F.pmod(F.xxhash64("host"), F.lit(HOST_GROUPS))
    sizes = {r[0]: r[1] for r in rows.groupBy(group.cast("int").alias("g")).count().collect()}
    parts = F.expr(f"array({', '.join(str(1 + sizes.get(g, 0) // pages_a_part) for g in range(HOST_GROUPS))})")[group.cast("int")]
    spread = found.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), parts).cast("int")).join(spread.hint("shuffle_merge"), ["host", "part"], "left")


def _extractor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, frozenset[int]] = {}
    for f in frames:
        out = []
        for host, page, template in zip(f["host"], f["html"], f["template"], strict=True):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = frozenset() if template is None else frozenset(np.asarray(template, np.int64).view(np.uint64).tolist())
            out.append(main_text(page, known[host]))
        yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": out})


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, ...).

    Null or empty html gives an empty text; a null url has the empty host; repeated rows are answered
    each; an empty table gives no rows.
    """
    host, _ = host_and_path(F.col("url"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), host.alias("host"), F.xxhash64("page_id", "url").alias("row"))
    found = templates(rows.select("row", "host", "html"))
    out = with_templates(rows, found).select("page_id", "url", "html", "host", "template").mapInPandas(_extractor, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extracted(table(spark, sf_dir, "pages"))
