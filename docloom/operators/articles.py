"""Stored web pages to article documents, and the crawl frontier as joins."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import summaries
from ..functions.rows import each
from ..functions.scalars import iso_text, lenient_timestamp, text_hash
from ..functions.text import stop_words

# the page reader travels with the UDF, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements whose text is not content, and elements that end a paragraph.
SKIPPED = {"script", "style", "nav", "footer", "header", "noscript", "aside", "title"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "div", "section", "blockquote"}
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "wbr"}
# Fixed value: selector text replaces the extracted text when that is at most this share of it.
SELECTOR_SHARE = 0.75


def url_id(url: Column) -> Column:
    return text_hash(url)


def with_scheme(url: Column) -> Column:
    """Add ``http://`` where an address has no scheme."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url).otherwise(
        F.concat(F.lit("http://"), url)
    )


def site_of(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(with_scheme(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def header_filename(disposition: Column) -> Column:
    """File name of a content-disposition header, null when there is none."""
    name = F.regexp_extract(disposition, r"filename=(.+)", 1)
    return F.when(F.length(name) > 0, name)


def page_title(html: Column) -> Column:
    """Title element, entities of the basic five decoded, null when missing or empty."""
    raw = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(F.length(raw) > 0, basic_entities(raw))


def page_language(html: Column) -> Column:
    """Two-letter language of the html element, null when missing."""
    code = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]{2})", 1))
    return F.when(F.length(code) > 0, code)


def basic_entities(c: Column) -> Column:
    """Decode the five basic entities; as in browsers the semicolon may be missing."""
    for entity, ch in (
        ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&amp;?", "&"),
    ):
        c = F.regexp_replace(c, entity, ch)
    return c


def page_links(html: Column) -> Column:
    """Distinct link targets of a page in text order."""
    return F.array_distinct(
        F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=\"([^\"#]+)"), F.lit(1))
    )


class _Reader(HTMLParser):
    """Collects paragraphs, metadata and the text below wanted selectors of one page."""

    def __init__(self, selectors: Sequence[Sequence[tuple[str, int | None]]] = ()):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.counts: list[int] = [0]
        self.skip = 0
        self.article_depth = 0
        self.parts: dict[bool, list[str]] = {True: [], False: []}
        self.meta: dict[str, str] = {}
        self.selectors = selectors
        self.picked: list[list[str]] = [[] for _ in selectors]
        self.open_picks: list[int] = [0] * len(selectors)
        self.pick_marks: list[list[int]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            a = dict(attrs)
            name = (a.get("name") or a.get("property") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"])
        if tag in BLOCKS:
            self._text("\n")
        self.counts[-1] += 1
        if tag in VOID:
            return
        self.stack.append((tag, self.counts[-1]))
        self.counts.append(0)
        if tag in SKIPPED:
            self.skip += 1
        if tag == "article":
            self.article_depth += 1
        marks = [i for i, s in enumerate(self.selectors) if self._selected(s)]
        for i in marks:
            if self.open_picks[i] == 0 and self.picked[i]:
                self.picked[i].append("\n\n")
            self.open_picks[i] += 1
        self.pick_marks.append(marks)

    def handle_endtag(self, tag):
        if tag in VOID or tag not in {t for t, _ in self.stack}:
            return
        while self.stack:
            top, _ = self.stack.pop()
            self.counts.pop()
            for i in self.pick_marks.pop():
                self.open_picks[i] -= 1
            if top in SKIPPED:
                self.skip -= 1
            if top == "article":
                self.article_depth -= 1
            if top == tag:
                break
        if tag in BLOCKS:
            self._text("\n")

    def handle_data(self, data):
        self._text(data)

    def _text(self, data: str) -> None:
        if self.skip:
            return
        self.parts[self.article_depth > 0].append(data)
        for i, n in enumerate(self.open_picks):
            if n:
                self.picked[i].append(data)

    def _selected(self, steps) -> bool:
        """The open elements end with the last step and contain the others above it."""
        at = len(self.stack) - 1
        if not steps or not _fits(self.stack[at], steps[-1]):
            return False
        for step in reversed(steps[:-1]):
            at -= 1
            while at >= 0 and not _fits(self.stack[at], step):
                at -= 1
            if at < 0:
                return False
        return True


def _fits(element: tuple[str, int], step: tuple[str, int | None]) -> bool:
    return step[0] in ("*", element[0]) and step[1] in (None, element[1])


STEP = re.compile(r"([\w-]+|\*)(?:\[(\d+)\])?")


def _steps(path: str) -> list[tuple[str, int | None]]:
    """Elements of a path such as ``/html/body/div[2]`` with their position among all children."""
    steps = []
    for part in filter(None, (p.strip() for p in path.split("/"))):
        found = STEP.fullmatch(part)
        if found is None:
            raise ValueError(f"cannot read step {part!r} of path {path!r}")
        element, position = found.groups()
        steps.append((element, None if position is None else int(position)))
    return steps


def _squeezed(parts: Sequence[str]) -> str:
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(parts).split("\n"))
    return "\n\n".join(x for x in lines if x)


ARTICLE = (
    "struct<content:string,selected:string,authors:array<string>,publish_date:string,top_image:string,"
    "description:string,error:string>"
)


def read_article(html: Column, xpaths: Sequence[str] = ()) -> Column:
    """Content and metadata of a whole page, and the longest text below one of the paths; needs a real parser, hence an Arrow-batched UDF."""
    wanted = [_steps(x) for x in xpaths]
    nothing = dict.fromkeys(
        ["content", "selected", "authors", "publish_date", "top_image", "description", "error"]
    )

    def one(page: str | None) -> dict:
        if page is None:
            return {**nothing, "error": "no html"}
        try:
            reader = _Reader(wanted)
            reader.feed(page)
            reader.close()
        except (AssertionError, ValueError, IndexError) as ex:
            return {**nothing, "error": f"{type(ex).__name__}: {ex}"}
        content = _squeezed(reader.parts[True]) or _squeezed(reader.parts[False])
        author = reader.meta.get("author") or reader.meta.get("article:author")
        return {
            "content": content,
            "selected": max((_squeezed(p) for p in reader.picked), key=len, default=""),
            "authors": [author] if author else [],
            "publish_date": reader.meta.get("article:published_time") or reader.meta.get("date"),
            "top_image": reader.meta.get("og:image"),
            "description": reader.meta.get("description"),
            "error": None,
        }

    @F.pandas_udf(ARTICLE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in pages], columns=list(nothing), dtype=object)

    return parse(html)


def small_batches(spark: SparkSession) -> None:
    """Pages reach Python in batches of a few MB; Spark's default of 10,000 rows takes GB of long pages. A value set by the caller stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def extract_articles(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    keep_html: bool = False,
    xpaths: Sequence[str] = (),
    stop: Sequence[str] | None = None,
) -> DataFrame:
    """Article documents from stored pages, one row per page.

    ``keywords`` are the most frequent words of the content without stop words (by default Spark's English list);
    ``summary`` is made of its heaviest sentences; ``publish_date`` is ISO text, null when the page's text is no date.
    """
    small_batches(pages.sparkSession)
    parsed = pages.withColumn("__a", read_article(F.col(html), xpaths))
    parsed = parsed.withColumn("__title", F.coalesce(page_title(F.col(html)), F.col(url)))
    parsed = parsed.withColumn("__content", override_content(F.col("__a.content"), F.col("__a.selected")))
    parsed = summarised(parsed, F.col("__content"), F.col("__title"), stop)
    ok = F.col("__a.error").isNull()
    out = [
        url_id(F.col(url)).alias("id"),
        F.lit("NewsArticle").alias("doc_type"),
        F.col(url).alias("url"),
        F.col("__title").alias("title"),
        F.col("__content").alias("content"),
        F.col("__keywords").alias("keywords"),
        F.col("__summary").alias("summary"),
        F.col("__a.authors").alias("authors"),
        iso_text(lenient_timestamp(F.col("__a.publish_date"))).alias("publish_date"),
        F.col("__a.top_image").alias("top_image"),
        site_of(F.col(url)).alias("source_url"),
        page_language(F.col(html)).alias("meta_lang"),
        ok.alias("scrape_status"),
        (~ok).alias("scrape_error"),
        F.col("__a.error").alias("scrape_error_message"),
    ]
    if keep_html:
        out.append(F.col(html).alias("html"))
    return parsed.select(*out)


def summarised(docs: DataFrame, content: Column, title: Column, stop: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``__keywords`` and ``__summary`` of a text; each step is a projection of the one before."""
    banned = stop_words() if stop is None else stop
    out = docs.withColumns({"__text": content, "__sentences": summaries.sentences(content)})
    out = out.withColumn("__keys", F.slice(summaries.counted(summaries.weighty(F.col("__text"), banned)), 1, summaries.KEYWORDS))
    scored = summaries.sentence_scores(F.col("__sentences"), title, F.col("__keys"), banned)
    out = out.withColumn("__scored", scored)
    out = out.withColumns({"__keywords": F.transform("__keys", lambda k: k["term"]), "__summary": summaries.best_sentences(F.col("__scored"))})
    return out.drop("__text", "__sentences", "__keys", "__scored")


def shared_summaries(articles: DataFrame, stop: Sequence[str] | None = None) -> DataFrame:
    """``url, keywords, summary, pages`` of addresses with several pages; ``articles`` has ``url, title, content``.

    Every content of an address meets every title of it. Equal contents and equal titles stand once, with their number. A
    keyword of a sentence counts as often as any page of the address has it at that place.
    """
    banned = stop_words() if stop is None else stop
    contents = articles.groupBy("url", "content").agg(F.count("*").alias("copies"))
    titles = articles.groupBy("url", "title").agg(F.count("*").alias("alike"))
    pages = articles.groupBy("url").agg(F.count("*").alias("pages"))
    terms = each(contents, ["url", "copies"], summaries.weighty(F.col("content"), banned), "term")
    first = Window.partitionBy("url").orderBy(F.desc("n"), "term")
    keys = terms.groupBy("url", "term").agg(F.sum("copies").alias("n")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= summaries.KEYWORDS)
    tops = keys.groupBy("url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda k: k["term"]).alias("keywords"), F.max("n").alias("top")
    )
    lines = each(contents, ["url", "copies"], summaries.sentences(F.col("content")), "text", at="at")
    lines = lines.groupBy("url", "at", "text").agg(F.sum("copies").alias("copies")).withColumn("words", summaries.weighty(F.col("text"), banned))
    met = each(lines, ["url", "at", "copies"], F.col("words"), "term").join(keys, ["url", "term"])
    hits = met.groupBy("url", "at").agg(F.sum(F.col("copies") * F.col("n")).alias("hits"))
    named = titles.withColumn("named", F.array_distinct(summaries.weighty(F.col("title"), banned)))
    held = lines.join(named, "url").join(pages, "url").join(tops, "url", "left").join(hits, ["url", "at"], "left")
    told = F.when(F.size("named") > 0, F.size(F.array_intersect("named", "words")) / F.size("named")).otherwise(0.0)
    keyed = F.when(F.size("words") > 0, F.coalesce(F.col("hits") * F.col("pages"), F.lit(0)) / F.col("top") / F.size("words")).otherwise(0.0)
    weight = F.round(summaries.TITLE_SHARE * told + summaries.KEYWORD_SHARE * keyed + summaries.PLACE_SHARE / (F.col("at") + 1), 9)
    scored = held.select("url", "at", "text", (-weight).alias("less"), (F.col("copies") * F.col("alike")).alias("times"))
    scored = scored.groupBy("url", "at", "text", "less").agg(F.sum("times").alias("times"))
    order = Window.partitionBy("url").orderBy("less", "at", "text")
    chosen = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= summaries.SENTENCES)
    before = F.coalesce(F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("times", F.least("times", summaries.SENTENCES - before)).filter("times > 0")
    # in the order of the text; of one place the heavier sentence first
    placed = F.array_sort(F.collect_list(F.struct("at", "less", "text", F.col("times").cast("int").alias("times"))))
    best = chosen.groupBy("url").agg(F.array_join(F.flatten(F.transform(placed, lambda s: F.array_repeat(s["text"], s["times"]))), "\n").alias("summary"))
    return pages.join(tops, "url", "left").join(best, "url", "left").select("url", "keywords", "summary", "pages")


def override_content(content: Column, selected: Column) -> Column:
    """Selector text wins over empty content and over content much shorter than it."""
    longer = F.length(selected) > 0
    short = F.length(content) <= SELECTOR_SHARE * F.length(selected)
    return F.when(longer & (F.coalesce(F.length(content), F.lit(0)) == 0), selected).when(
        longer & short, selected
    ).otherwise(content)


def frontier(
    links: DataFrame,
    stored: DataFrame,
    accept_langs: Sequence[str] = (),
    corpus: str | None = None,
) -> DataFrame:
    """New article documents from discovered links.

    ``links`` has ``source_url, url`` and optionally ``corpus, meta_lang``; ``stored`` has
    ``url``. Known addresses are dropped by an anti-join and every article refers to its source.
    """
    fresh = links.withColumn("url", F.trim("url")).join(stored.select("url").distinct(), "url", "left_anti")
    own = F.col("corpus") if "corpus" in links.columns else F.lit(None).cast("string")
    out = fresh.select(
        url_id(F.col("url")).alias("id"),
        F.lit("NewsArticle").alias("doc_type"),
        "url",
        F.col("url").alias("title"),
        F.col("source_url").alias("original_source_url"),
        F.struct(
            F.lit("SourceUrl").alias("doc_type"), url_id(F.col("source_url")).alias("id")
        ).alias("has_source"),
        F.coalesce(own, F.lit(corpus)).alias("corpus"),
        *([F.col("meta_lang")] if "meta_lang" in links.columns else []),
    )
    if accept_langs and "meta_lang" in links.columns:
        out = out.filter(F.col("meta_lang").isNull() | F.col("meta_lang").isin(list(accept_langs)))
    return out


def source_counts(articles: DataFrame) -> DataFrame:
    """Articles kept per source."""
    return articles.groupBy("original_source_url").agg(F.count("*").alias("last_scrape_count"))


def rescrape_split(requests: DataFrame, stored: DataFrame, key: str = "id"):
    """Stored documents to return as they are, and requests that still have to be extracted."""
    return (
        stored.join(requests.select(key).distinct(), key, "left_semi"),
        requests.join(stored.select(key).distinct(), key, "left_anti"),
    )


