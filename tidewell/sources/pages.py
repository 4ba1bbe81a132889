"""The page job: links, articles, paragraphs, block pages and write requests from a table of fetched pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.keys import absolute_url, host, html_to_text, normalize_url
from tidewell.functions.text import as_column, fold

HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def extract_links(pages: DataFrame, rules: DataFrame | None = None, most: int = 30) -> DataFrame:
    """(source, url, pos): article links per source host, first occurrence first, at most `most` per source.

    rules(host, pattern) keep matching links; without rules every http link counts.
    """
    found = F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("pos", "href")
    links = pages.select("page_id", "url", found).select(host("url").alias("source"), "page_id", "pos", normalize_url(absolute_url("url", "href")).alias("link"))
    links = links.filter(F.col("link").rlike("^https?://"))
    if rules is not None:
        links = links.join(rules, links["source"] == rules["host"]).filter(F.expr("link RLIKE pattern")).select("source", "page_id", "pos", "link")
    first = links.groupBy("source", F.col("link").alias("url")).agg(F.min(F.struct("page_id", "pos")).alias("at"))
    w = Window.partitionBy("source").orderBy("at", "url")
    return first.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most).select("source", "url", "pos")


class _Collector(HTMLParser):
    """Texts of elements by tag and class, in document order; script and style are skipped."""

    BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "td", "article", "section", "time"}
    VOID = {"br", "img", "meta", "link", "input", "hr", "source"}

    def __init__(self, wanted: list[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack, self.found, self.hidden = wanted, [], {w: [] for w in wanted}, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "p":  # an open paragraph ends where the next begins
            self._close("p", stop=("article", "div", "section", "body"))
        names = {f".{c}" for c in (dict(attrs).get("class") or "").split()}
        inside = {t for t, _, _ in self.stack}
        hits = [w for w in self.wanted if self._fits(w, tag, names, inside)]
        self.stack.append((tag, hits, []))

    @staticmethod
    def _fits(want: str, tag: str, names: set, inside: set) -> bool:
        *outer, last = want.split()
        return (last == tag or last in names) and all(o in inside for o in outer)

    def _close(self, tag: str, stop=()):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in stop:
                return
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    name, hits, text = self.stack.pop()
                    joined = " ".join("".join(text).split())
                    for h in hits:
                        if joined:
                            self.found[h].append(joined)
                    if self.stack:
                        self.stack[-1][2].extend([" ", *text, " "] if name in self.BLOCKS else text)
                return

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        self._close(tag)

    def handle_data(self, data):
        if self.stack and not self.hidden:
            self.stack[-1][2].append(data)


#: Selectors tried in order: a tag, a .class, or one inside another ("article p").
DEFAULT_RULES = {"title": ["article h1", "h1", "title"], "content": ["article p", ".content p", "p"], "published": ["time", ".date"]}


def extract_articles(pages: DataFrame, rules: dict[str, list[str]] = DEFAULT_RULES) -> DataFrame:
    """(page_id, url, title, content, published_at_raw); content is one paragraph per line. A bad page gives nulls."""
    wanted = sorted({s for r in rules.values() for s in r})

    def first(found: dict, names: list[str], many: bool):
        for n in names:
            if found[n]:
                return "\n".join(found[n]) if many else found[n][0]
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                c = _Collector(wanted)
                c.feed(html or "")
                c.close()
                while c.stack:
                    c._close(c.stack[-1][0])
                out.append((page, url, first(c.found, rules["title"], False), first(c.found, rules["content"], True), first(c.found, rules.get("published", []), False)))
            yield pd.DataFrame(out, columns=["page_id", "url", "title", "content", "published_at_raw"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, content string, published_at_raw string")


def select_paragraphs(paragraphs: DataFrame, stop: list[str], least: int = 20) -> DataFrame:
    """(page_id, content): paragraphs(page_id, pos, text, title) in order up to the first with a stop phrase; repeats of
    the title and short ones drop."""
    w = Window.partitionBy("page_id")
    is_stop = fold("text").rlike("|".join(stop)) if stop else F.lit(False)
    rows = paragraphs.withColumn("_stop", F.min(F.when(is_stop, F.col("pos"))).over(w)).filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    rows = rows.filter((F.length(F.trim("text")) >= least) & ~fold("text").eqNullSafe(fold("title")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.groupBy("page_id").agg(F.array_join(ordered, "\n").alias("content"))


def is_blocked(html) -> Column:
    """Whether a page is a bot challenge; empty pages count as blocked, short-page signs only under 15 000 characters."""
    h = F.lower(F.coalesce(as_column(html), F.lit("")))
    has = lambda *signs: F.exists(F.array(*[F.lit(s) for s in signs]), lambda s: F.contains(h, s))
    return (h == "") | has("cf-challenge", "cf-chl-widget", "your request was blocked") | ((F.length(h) < 15_000) & has("just a moment", "attention required", 'id="challenge-platform"'))


def build_request(articles: DataFrame, sources: DataFrame, parser: str) -> DataFrame:
    """Write requests: articles with the constants of their source."""
    s = sources.select(F.col("domain").alias("domain"), "source_id", F.col("display_name").alias("source_name"))
    rows = articles.withColumn("domain", host("url")).join(s, "domain", "left")
    return rows.select("source_id", "domain", "source_name", F.col("url").alias("canonical_url"), "title", "content", F.lit("").alias("summary"), "published_at_raw", F.lit(parser).alias("parser_version"))


def reject_incomplete(requests: DataFrame, in_lookback: Column) -> DataFrame:
    """requests with outcome: invalid_record, lookback_filtered or ok."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return requests.withColumn("outcome", F.when(blank("title") | blank("content"), "invalid_record").when(~in_lookback, "lookback_filtered").otherwise("ok"))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_to_text("html").alias("text"))
