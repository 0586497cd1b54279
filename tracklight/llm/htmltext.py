"""Main text of web pages: blocks from the markup, and a suffix array per host for runs that pages of the host share.

The tokens of all blocks of a host's pages, end to end, go into suffix arrays, a slice of pages each.  A run that two pages of any
slice share is counted on all pages of the host; one on enough of them is boilerplate.  Blocks that such runs cover go, inside an
article too where most pages have them; other text of an article and other unmarked text stays; of what is left the markup says
what is a menu, a footer, an advert and the like.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, prepare, table

#: Fixed values of HTML: elements without content, elements whose content is no markup, and elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold the article (a header inside an article holds its title), whole words in class or id that mean the
#: same anywhere, and words in class, id or role that mark such parts outside articles.
OUTSIDE = frozenset("nav header footer aside form menu dialog button head".split())
PLAIN = frozenset("ad ads advert advertisement advertising sponsored comments comment-list disqus_thread".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|side|widget|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|replies|disqus|pagination|pager|toolbar|skip|legal|copyright|search|login|navigation|complementary|contentinfo|alert)(?=$|[\s_-])", re.I)
MAIN = frozenset(("article", "main"))

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attr = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b(?!\s*=)", re.I)


#: Where a block stands: in a part that an element or a plain word names as no article; in one that a class word marks outside
#: articles; in no marked part; in an article; in a part of an article that a class word marks.
NO_ARTICLE, MARKED_OUTSIDE, UNMARKED, ARTICLE, MARKED_INSIDE = range(5)


def _place(now: int, name: str, marks: str) -> int:
    """The place within an element, from the place around it."""
    if now == NO_ARTICLE or (name in OUTSIDE and not (name == "header" and now >= ARTICLE)) or " hidden " in f" {marks} " or (name not in ("html", "body") and not PLAIN.isdisjoint(marks.lower().split())):
        return NO_ARTICLE
    if name in MAIN:
        return ARTICLE if now == UNMARKED else now
    if marks and name not in ("html", "body") and MARKED.search(marks):
        return {UNMARKED: MARKED_OUTSIDE, ARTICLE: MARKED_INSIDE}.get(now, now)
    return now


def blocks(page: str) -> list[tuple[int, str]]:
    """(place, text) of each block in page order.  Text has references decoded and white space made one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open block elements with the place that held outside them
    buf: list[str] = []
    place, at, n = UNMARKED, 0, len(page)

    def flush() -> None:
        if buf:
            if text := " ".join(html.unescape("".join(buf)).split()):
                out.append((place, text))
            buf.clear()

    while at < n:
        m = _tag.search(page, at)
        if not m:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    place = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else n if name in ("script", "style") else at
            continue
        if name in INLINE or name in VOID:
            if name == "br":
                buf.append(" ")
            elif name in VOID and name not in INLINE:
                flush()
            continue
        flush()
        if name == "p" and stack and stack[-1][0] == "p":
            place = stack.pop()[1]
        stack.append((name, place))
        if m[3] and m[3].endswith("/") and name not in MAIN:
            continue
        marks = " ".join(a.strip("\"'") or b for a, b in _attr.findall(m[3])) if m[3] else ""
        place = _place(place, name, marks)
    flush()
    return out


#: Tokens of a run; share of a block that runs must cover; share of the host's pages that makes a run boilerplate outside and
#: inside articles, and pages that either takes at least: two or three copies of a paragraph are none.
DEPTH, COVERED, OFTEN, MOST, FEW = 8, 0.9, 0.02, 0.5, 4
#: Characters of markup in a slice of a host, and pages that it holds at least: a run on so many of the pages is then on two
#: pages of some slice.
SLICE, LEAST_PAGES = 4_000_000, 51
_U = np.uint64


def token_hashes(page: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each token of a page's blocks, with one for each block's end, and where each block begins (and the page ends)."""
    from xxhash import xxh64_intdigest

    tokens, begins = [], [0]
    for _, text in page:
        tokens += text.split(" ")
        tokens.append("\n")
        begins.append(len(tokens))
    known = {t: xxh64_intdigest(t.encode()) for t in set(tokens)}
    return np.fromiter(map(known.__getitem__, tokens), _U, len(tokens)), np.array(begins)


def run_hashes(h: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A hash for each run of `depth` tokens."""
    n = max(0, len(h) - depth + 1)
    x = np.zeros(n, _U)
    for j in range(depth):
        x = (x ^ x >> _U(29)) * _U(0x9E3779B97F4A7C15) + h[j : j + n]
    return x ^ x >> _U(32)


class HostSuffixes:
    """Token streams of pages, end to end, in suffix order down to `depth` tokens (prefix doubling), which brings together the
    places of every run of at least `depth` tokens."""

    def __init__(self, pages: list[np.ndarray], depth: int = DEPTH) -> None:
        n = sum(map(len, pages)) + len(pages)
        page = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
        border = np.append(page[1:] != page[:-1], True) if n else np.zeros(0, bool)
        stream = np.zeros(n, _U)
        stream[~border] = np.concatenate([*pages, np.zeros(0, _U)])
        rank = np.unique(stream, return_inverse=True)[1].astype(np.int64) + len(pages)
        rank[border] = np.arange(len(pages))  # each border is unlike anything else
        size = 1
        while size < depth:
            step = min(size, depth - size)
            shifted = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n]
            rank = np.unique(rank * (n + len(pages) + 1) + shifted + 1, return_inverse=True)[1].astype(np.int64)
            size += step
        self.order = np.argsort(rank, kind="stable")
        self.rank, self.page, self.border, self.depth = rank[self.order], page[self.order], border, depth

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """A place of each run that two pages have, and how many pages have it."""
        if not len(self.order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.append(True, self.rank[1:] != self.rank[:-1])
        other = new | np.append(True, self.page[1:] != self.page[:-1])  # places of one run stand in the order of pages
        head = np.flatnonzero(new)
        pages = np.add.reduceat(other.astype(np.int64), head)
        take = pages > 1
        at = self.order[head[take]]
        ends = np.concatenate([[0], np.cumsum(self.border)])
        inside = at + self.depth <= len(self.border)
        inside[inside] = ends[at[inside] + self.depth] == ends[at[inside]]
        return at[inside], pages[take][inside]


def covered(h: np.ndarray, runs: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which tokens lie in one of the given runs (their hashes, sorted)."""
    x = run_hashes(h, depth)
    hit = np.zeros(len(x), bool)
    if len(runs) and len(x):
        hit = runs[np.minimum(np.searchsorted(runs, x), len(runs) - 1)] == x
    out = np.zeros(len(h), bool)
    for k in range(depth):
        out[k : k + len(hit)] |= hit
    return out


def decided(page: list[tuple[int, str]], often: np.ndarray, most: np.ndarray) -> tuple[str, list[int]]:
    """The main text of a page, and how many of its blocks boilerplate runs removed, the markup removed, and were kept.

    often: runs that are boilerplate outside articles and in marked parts of them, most: those that are inside too.  Covered
    blocks go.  Of the rest, what an element or a plain word names as no article goes, and outside articles what a class word
    marks.
    """
    h, begins = token_hashes(page)
    keep, n = [], [0, 0, 0]
    wide, narrow = covered(h, often), covered(h, most)
    for (place, text), a, b in zip(page, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if (narrow if place == ARTICLE else wide)[a : b - 1].mean() >= COVERED:
            n[0] += 1
        elif place in (NO_ARTICLE, MARKED_OUTSIDE):
            n[1] += 1
        else:
            n[2] += 1
            keep.append(text)
    return " ".join(keep), n


def pages_with(streams: list[np.ndarray], runs: np.ndarray) -> np.ndarray:
    """On how many of the pages (token hashes) each of the runs (their hashes, sorted) is."""
    n = np.zeros(len(runs), np.int64)
    for h in streams if len(runs) else ():
        x = np.unique(run_hashes(h))
        at = np.minimum(np.searchsorted(runs, x), len(runs) - 1)
        n[at[runs[at] == x]] += 1
    return n


def _counted(own: DataFrame, runs: DataFrame, by: list[str], streams) -> DataFrame:
    """host, run, n: how many of the host's pages have each run, counted slice by slice."""
    lists = runs.groupBy("host").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.max("parts").alias("parts"))
    heads = lists.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("salt"), F.lit(0).alias("kind"), "runs", F.lit(None).cast("array<string>").alias("texts"))
    rest = own.join(lists.select("host"), "host", "left_semi").select("host", F.col("salt").cast("long").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("runs"), "texts")

    def count(batches):
        key, sought, n = None, np.zeros(0, _U), np.zeros(0, np.int64)

        def done():
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * int(some.sum()), pa.string()), pa.array(sought[some].view(np.int64)), pa.array(n[some])], names=["host", "run", "n"])

        for b in batches:
            for h, s, kind, runs_, texts in zip(*(b.column(c).to_pylist() for c in (*by, "kind", "runs", "texts")), strict=True):
                if kind == 0:
                    if key is not None:
                        yield done()
                    key, sought = (h, s), np.sort(np.array(runs_, np.int64).view(_U))
                    n = np.zeros(len(sought), np.int64)
                else:
                    n += pages_with([token_hashes([(0, t) for t in texts])[0]], sought)
        if key is not None:
            yield done()

    both = heads.unionByName(rest).repartition(*by).sortWithinPartitions(*by, "kind")
    return both.mapInArrow(count, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))


def extract(pages: DataFrame, slice_chars: int = SLICE) -> DataFrame:
    """page_id, url, text of every page, and how many of its blocks runs removed, the markup removed, and stayed (n_runs,
    n_markup, n_kept).

    A host's pages are dealt by hash into slices of about slice_chars characters, of LEAST_PAGES pages at least.  A run that is
    on two pages of a slice is a candidate; it is then counted on every page of the host, so that what is boilerplate doesn't
    depend on the slices.  It is boilerplate on a fiftieth of the host's pages (half of them, inside articles) and FEW at least.
    Candidates that can't come to that, having two pages in too few slices, aren't counted.  A page of any length is taken whole.
    A null html counts as empty and gives an empty text; a null url is a host of its own; rows that share a page_id are a page
    each; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    prepare(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))

    def parse(batches):
        for b in batches:
            found = [blocks(x) for x in b.column("html").to_pylist()]
            cols = [pa.array([[p for p, _ in x] for x in found], pa.list_(pa.int8())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), *cols], names=["page_id", "url", "host", "places", "texts"])

    parts = F.greatest(F.lit(1).cast("long"), F.least(F.ceil(F.sum(F.length("html")) / slice_chars), F.floor(F.count(F.lit(1)) / LEAST_PAGES))).cast("int")
    hosts = materialise(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), parts.alias("parts")), "hosts")
    parsed = rows.mapInArrow(parse, "page_id long, url string, host string, places array<tinyint>, texts array<string>")  # in each pass: cheaper than to keep it
    own = parsed.join(hosts, "host").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")))
    by = ["host", "salt"]

    def streams(batches):
        """Of each slice: its key and its pages' token hashes."""
        key, held = None, []
        for b in batches:
            for h, s, texts in zip(*(b.column(c).to_pylist() for c in (*by, "texts")), strict=True):
                if held and (h, s) != key:
                    yield key, held
                    held = []
                key = (h, s)
                held.append(token_hashes([(0, t) for t in texts])[0])
        if held:
            yield key, held

    def count(batches):
        for key, held in streams(batches):
            at, pages_ = HostSuffixes(held).shared()
            stream = np.concatenate([x for h in held for x in (h, np.zeros(1, _U))])
            runs = run_hashes(stream)[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.string()), pa.array(runs), pa.array(pages_)], names=["host", "run", "n"])

    dealt = own.select(*by, "texts").repartition(*by).sortWithinPartitions(*by)
    found = dealt.mapInArrow(count, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("low"), F.count(F.lit(1)).alias("slices"))
    # Each slice that isn't heard of has the run on one page at most.
    least = F.greatest(F.lit(FEW), F.ceil(OFTEN * F.col("pages")))
    able = materialise(found.join(hosts, "host").where(F.col("low") + F.col("parts") - F.col("slices") >= least).select("host", "run", "low", "slices", "pages", "parts"), "candidates")
    half = F.greatest(F.lit(FEW), F.ceil(MOST * F.col("pages")))
    high = F.col("low") + F.col("parts") - F.col("slices")
    open_ = ((F.col("low") < least) & (high >= least)) | ((F.col("low") < half) & (high >= half))
    sure = able.where(~open_).select("host", "run", F.col("low").alias("n"))
    runs = sure.unionByName(_counted(own, able.where(open_), by, streams)) if not able.where(open_).isEmpty() else sure
    marked = runs.join(hosts, "host").where(F.col("n") >= least).withColumn("inside", F.col("n") >= half)
    listed = materialise(marked.groupBy("host").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.sort_array(F.collect_list(F.when(F.col("inside"), F.col("run")))).alias("most")), "runs")
    first = listed.join(hosts, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("salt"), "runs", "most")
    none = F.lit(None)
    first = first.select(*by, F.lit(0).alias("kind"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("array<tinyint>").alias("places"), none.cast("array<string>").alias("texts"), "runs", "most")
    rest = own.select("host", F.col("salt").cast("long").alias("salt"), F.lit(1).alias("kind"), "page_id", "url", "places", "texts", none.cast("array<bigint>").alias("runs"), none.cast("array<bigint>").alias("most"))

    def decide(batches):
        key, often, most = None, np.zeros(0, _U), np.zeros(0, _U)
        for b in batches:
            out = []
            for h, s, kind, page_id, url, places, texts, runs_, most_ in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if (h, s) != key:
                    key, often, most = (h, s), np.zeros(0, _U), np.zeros(0, _U)
                if kind == 0:
                    often, most = (np.sort(np.array(x, np.int64).view(_U)) for x in (runs_, most_))
                else:
                    text, n = decided(list(zip(places, texts, strict=True)), often, most)
                    out.append((page_id, url, text, *n))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["page_id", "url", "text", "n_runs", "n_markup", "n_kept"])

    both = first.unionByName(rest).repartition(*by).sortWithinPartitions(*by, "kind")
    return both.mapInArrow(decide, "page_id long, url string, text string, n_runs long, n_markup long, n_kept long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
