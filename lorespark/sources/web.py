"""Web sources: main text of HTML, fetched pages with a cache, searches with a fallback, and which reader takes what."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.websearch import SNIPPET, page_keywords, ranked_results

# What is dropped with all it holds, from how many characters a text is usable, and what is said of a refusal.
DROPPED = {"script", "style", "nav", "footer", "header", "aside"}
USABLE = 100
DENIED = "Access denied (403) for {}. Try pasting the article text directly via 'Paste text'."
_BLOCK = set("address article blockquote dd div dl dt figure figcaption form h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul body html br".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class _Tree(HTMLParser):
    """Blocks of text with the path of elements that they stand in; character references are decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.parent: list[int] = [-1]
        self.at, self.dropped, self.linked = 0, 0, 0
        #: (element, text, characters of it in links)
        self.blocks: list[list] = []
        self.fresh = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.fresh |= tag in _BLOCK
        if tag in _VOID:
            return
        self.parent.append(self.at)
        self.at = len(self.parent) - 1
        self.open.append((tag, self.at))
        self.dropped += tag in DROPPED or tag in ("title", "noscript", "template")
        self.linked += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.fresh |= tag in _BLOCK
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, node = self.open.pop()
            self.at = self.parent[node]
            self.dropped -= t in DROPPED or t in ("title", "noscript", "template")
            self.linked -= t == "a"
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.dropped or not data.strip():
            return
        if self.fresh or not self.blocks or self.blocks[-1][0] != self.at and not self._inline(self.blocks[-1][0]):
            self.blocks.append([self.at, "", 0])
            self.fresh = False
        self.blocks[-1][1] += data
        self.blocks[-1][2] += len(data.strip()) * bool(self.linked)

    def _inline(self, node: int) -> bool:
        """Whether text goes on in an inline element of the block that it is in."""
        at = self.at
        while at >= 0:
            if at == node:
                return True
            at = self.parent[at]
        at = node
        while at >= 0:
            if at == self.at:
                return True
            at = self.parent[at]
        return False


def main_text(html: str | None) -> str:
    """The text of the element that holds most of a page's prose; all of its text where none stands out.

    A block's prose is what of it is not in links, from 25 characters on. From the root on the walk goes down while one child
    holds nine tenths of the prose.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    blocks = [(node, " ".join(text.split()), linked) for node, text, linked in tree.blocks]
    prose = [0] * len(tree.parent)
    for node, text, linked in blocks:
        own = len(text) - linked
        own = own if own >= 25 else 0
        while node >= 0:
            prose[node] += own
            node = tree.parent[node]
    children: dict[int, list[int]] = {}
    for node, parent in enumerate(tree.parent):
        children.setdefault(parent, []).append(node)
    at = 0
    while prose[at] and (best := max(children.get(at, []), key=prose.__getitem__, default=None)) is not None and prose[best] >= 0.9 * prose[at]:
        # a paragraph is no region: the last step is to what holds several blocks
        if sum(1 for n, _, _ in blocks if _within(tree.parent, n, best)) < 2:
            break
        at = best
    return "\n".join(text for node, text, _ in blocks if _within(tree.parent, node, at))


def _within(parent: list[int], node: int, root: int) -> bool:
    while node > root:
        node = parent[node]
    return node == root


@F.pandas_udf(T.StringType())
def html_main_text(html: pd.Series) -> pd.Series:
    return pd.Series([main_text(h) for h in html], dtype=object)


#: fetch(url): (status, content type, body); it may raise.
Fetch = Callable[[str], tuple[int, str, str]]


def fetched(urls: DataFrame, fetch: Fetch, refetch: Fetch | None = None, cache: DataFrame | None = None, per_host: int = 4) -> DataFrame:
    """(url, text, error, cached) for distinct urls (url): a page's main text, or why there is none.

    What the cache (url, text) has is not fetched. The text counts if it has more than 100 characters; else, or if the first
    fetch fails, refetch is asked, whose pages count as they are: HTML as text, other types as their body, status 403 as refused.
    The urls of a host go to `per_host` tasks at most, so that no host is asked by many at once.
    """
    own = urls.select("url").where("url IS NOT NULL").distinct()
    known = own.join(cache.select("url", "text").dropDuplicates(["url"]), "url").select("url", "text", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")) if cache is not None else None
    left = own if cache is None else own.join(cache.select("url"), "url", "left_anti")

    def one(url: str) -> tuple[str | None, str | None]:
        try:
            status, _, body = fetch(url)
            text = main_text(body).strip() if status == 200 else ""
            if len(text) > USABLE:
                return text, None
        except Exception:  # noqa: BLE001  a fetch may fail in any way; the second one is asked
            pass
        try:
            status, kind, body = (refetch or fetch)(url)
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"
        if status == 403:
            return None, DENIED.format(url)
        if status != 200:
            return None, f"status {status} for {url}"
        return (main_text(body) if kind.startswith("text/html") else body), None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(u) for u in pdf["url"]]
            yield pd.DataFrame({"url": pdf["url"], "text": [t for t, _ in got], "error": [e for _, e in got], "cached": False})

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1))
    new = left.repartition(host, F.pmod(F.xxhash64("url"), F.lit(per_host))).mapInPandas(each, "url string, text string, error string, cached boolean")
    return new if known is None else known.unionByName(new)


#: search(query, most): results as (title, body, href) in order; it may raise. fallback(concept, most): as that.
Search = Callable[[str, int], list[tuple[str, str, str]]]


def searched(asked: DataFrame, search: Search, fallback: Search, k: int = 3, keep: Callable[[DataFrame], DataFrame] = lambda df: df, cache: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, label, url, snippet, source) for asked (query_id, concept, page_body): the best results of a search, ranked.

    The query is the quoted concept with the page's keywords; without a result it is asked again unquoted. Where the search fails,
    or no result has a score, the fallback is asked. keep stores what was found, so that no call is made twice. The cache (concept,
    page_hash, rank, label, url, snippet, source) answers what it has; page_hash is the MD5 of the page's text.
    """
    keyed = asked.withColumn("page_hash", F.md5(F.coalesce("page_body", F.lit("")).cast("binary")))
    out = None
    if cache is not None:
        seen = cache.select("concept", "page_hash").distinct()
        out = keyed.select("query_id", "concept", "page_hash").join(cache, ["concept", "page_hash"]).select("query_id", "rank", "label", "url", "snippet", "source")
        keyed = keyed.join(seen, ["concept", "page_hash"], "left_anti")
    words = page_keywords(keyed.where("page_body IS NOT NULL"), "query_id", "page_body")
    queries = keyed.select("query_id", "concept").join(words, "query_id", "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    got = search(f'"{r.concept}" {r.keywords}'.strip(), 3 * k) or search(f"{r.concept} {r.keywords}".strip(), 3 * k)
                except Exception:  # noqa: BLE001  a search may fail in any way
                    got = []
                out += [(r.query_id, n, *x) for n, x in enumerate(got)]
            yield pd.DataFrame(out, columns=["query_id", "pos", "title", "body", "href"])

    kind = keyed.schema["query_id"].dataType.simpleString()
    raw = keep(queries.mapInPandas(ask, f"query_id {kind}, pos long, title string, body string, href string"))
    best = keep(ranked_results(keyed, raw, k).select("query_id", "rank", "label", "url", "snippet", F.lit("Web").alias("source")))

    def fall(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    got = fallback(r.concept, k)
                except Exception:  # noqa: BLE001
                    got = []
                out += [(r.query_id, n, title, href, body) for n, (title, body, href) in enumerate(got[:k], 1)]
            yield pd.DataFrame(out, columns=["query_id", "rank", "label", "url", "snippet"])

    bare = queries.select("query_id", "concept").join(best.select("query_id").distinct(), "query_id", "left_anti")
    more = bare.mapInPandas(fall, f"query_id {kind}, rank int, label string, url string, snippet string")
    more = more.withColumn("snippet", F.left(F.regexp_replace("snippet", "<[^>]+>", ""), F.lit(SNIPPET))).withColumn("source", F.lit("Wikipedia"))
    found = best.unionByName(keep(more))
    return found if out is None else out.unionByName(found)


@dataclass(frozen=True)
class Reader:
    """A kind of source: what it claims, and how its rows (source) become (source, text, error)."""

    name: str
    claims: Callable[[Column], Column]
    read: Callable[[DataFrame], DataFrame]


def read_sources(sources: DataFrame, readers: list[Reader]) -> DataFrame:
    """(source, reader, text, error): each source by the first reader that claims it; one that none claims says so."""
    claimed = F.coalesce(*[F.when(r.claims(F.col("source")), F.lit(k)) for k, r in enumerate(readers)], F.lit(-1))
    rows = sources.select("source").distinct().withColumn("_reader", claimed)
    out = rows.where("_reader = -1").select("source", F.lit(None).cast("string").alias("reader"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("no reader for "), "source").alias("error"))
    for k, r in enumerate(readers):
        out = out.unionByName(r.read(rows.where(F.col("_reader") == k).select("source")).select("source", F.lit(r.name).alias("reader"), "text", "error"))
    return out


def web_reader(fetch: Fetch, refetch: Fetch | None = None, cache: DataFrame | None = None) -> Reader:
    def read(rows: DataFrame) -> DataFrame:
        return fetched(rows.withColumnRenamed("source", "url"), fetch, refetch, cache).withColumnRenamed("url", "source")

    return Reader("web", lambda s: F.rlike(s, F.lit("^https?://")), read)
