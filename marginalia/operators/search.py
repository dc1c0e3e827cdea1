"""Search hits: find, select, number, and fetch their pages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.htmltext import page_title, rate_limit_seconds, strip_html
from ..functions.markdown import page_block, page_error_block
from ..functions.patterns import matches_any
from ..session import materialize
from .joins import join_keys
from .numbering import numbered
from .ordered import latest

TOP_SLICES = 64


def all_terms(text: Column, query: str) -> Column:
    return reduce(lambda a, b: a & b, (text.contains(F.lit(t)) for t in query.split()), F.lit(True))


def corpus_search(pages: DataFrame, queries: Sequence[str], text: str, ignore_case: bool = True) -> DataFrame:
    """Pages that hold all terms of a query, as ``(query, page_id, url)``; their order is ``page_id``.

    Queries are options: each page is read once and tested against all of them, without join or shuffle.
    """
    fold = (lambda q: q.lower()) if ignore_case else (lambda q: q)
    body = F.lower(F.col(text)) if ignore_case else F.col(text)
    searched = pages.select("page_id", "url", body.alias("__body"))
    found = F.array_compact(
        F.array(*(F.when(all_terms(F.col("__body"), fold(q)), F.lit(q)) for q in queries))
    )
    return searched.select(F.explode(found).alias("query"), "page_id", "url")


def hit_positions(hits: DataFrame, slice_ids: int = 1 << 16) -> DataFrame:
    """Hits with ``pos``, their place in the list of their query.

    Only lists that are shown whole need places; picking the first N does not. The hits are written out
    first, so the pages are searched once although numbering reads its rows twice.
    """
    settled = materialize(hits, "hits")
    order = [F.col("page_id"), F.col("url")]
    return numbered(settled, ["query"], order, F.expr(f"page_id div {slice_ids}"), "pos")


_RESPONSE = "webPages struct<value: array<struct<url: string>>>, items array<struct<link: string>>"


def response_hits(responses: DataFrame) -> DataFrame:
    """Stored responses ``(query, offset, body)`` to hit rows ``(query, offset, pos, url)``, either shape."""
    parsed = F.from_json("body", _RESPONSE)
    urls = F.coalesce(
        F.transform(parsed["webPages"]["value"], lambda r: r["url"]),
        F.transform(parsed["items"], lambda r: r["link"]),
    )
    rows = responses.select("query", "offset", F.posexplode(urls).alias("pos", "url"))
    return rows.filter(F.col("url").isNotNull())


def url_valid(url: Column) -> Column:
    return F.coalesce(url.startswith("http"), F.lit(False))


def invalid_requests(requests: DataFrame, key: str = "request") -> DataFrame:
    """Message lines of request lists that hold a bad URL, as rows ``(key, ord, line)``; null ord is the heading.

    One bad URL rejects its whole list. Only the counts are grouped; the lines stay rows.
    """
    bad = requests.filter(~url_valid(F.col("url")))
    counted = bad.groupBy(key).agg(F.count(F.lit(1)).alias("__bad"))
    heads = counted.filter(F.col("__bad") > 1).select(
        key, F.lit(None).cast("bigint").alias("ord"), F.lit("Invalid URLs:").alias("line")
    )
    single = F.concat(F.lit("Invalid URL: "), F.col("url"))
    line = F.when(F.col("__bad") == 1, single).otherwise(F.concat(F.lit("  "), F.col("url")))
    lines = join_keys(bad, counted, [key]).select(key, F.col("ord").cast("bigint").alias("ord"), line.alias("line"))
    return heads.unionByName(lines)


def accepted_requests(requests: DataFrame, key: str = "request") -> DataFrame:
    """Requests of lists whose URLs are all valid."""
    bad = requests.filter(~url_valid(F.col("url"))).select(key).distinct()
    return requests.join(bad, key, "left_anti")


def url_exclude(hits: DataFrame, patterns: Iterable[str], own_hosts: Iterable[str] = ()) -> DataFrame:
    url = F.col("url")
    own = reduce(lambda a, h: a | url.contains(F.lit(h)), own_hosts, F.lit(False))
    return hits.filter(url.startswith("http") & ~matches_any(url, patterns) & ~own)


def dedup_first(hits: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Each URL once per query, where it came first; combined before the shuffle."""
    if len(order) == 1:
        return hits.groupBy("query", "url").agg(F.min(order[0]).alias(order[0]))
    first = F.min(F.struct(*order)).alias("__first")
    return hits.groupBy("query", "url").agg(first).select("query", "url", "__first.*")


def top_n_per_query(hits: DataFrame, n: int = 10, order: Sequence[str] = ("pos",)) -> DataFrame:
    """The first N hits of each query with their rank.

    A query's hits are dealt to ``TOP_SLICES`` slices by digest, each slice keeps its first N, and the first N of
    these are the answer. So a query that matches most of the corpus is ranked by many tasks, whatever N and
    the kind of the order columns, and one task sees N rows per slice at most.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(TOP_SLICES))
    within = F.row_number().over(Window.partitionBy("query", salt).orderBy(*order))
    first = hits.withColumn("__within", within).filter(F.col("__within") <= n).drop("__within")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n)


def select_hits(
    hits: DataFrame,
    n: int,
    patterns: Iterable[str] = (),
    own_hosts: Iterable[str] = (),
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """The first N different URLs of each query that are not excluded."""
    return top_n_per_query(dedup_first(url_exclude(hits, patterns, own_hosts), order), n, order)


def search_section(spark, queries: Sequence[str], hits: DataFrame, provider: str = "Corpus") -> DataFrame:
    """Heading and URL list per query, or a note that nothing was found. Hits are at most N per query."""
    asked = spark.createDataFrame(list(enumerate(queries)), "query_ord int, query string")
    listed = hits.groupBy("query").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "url"))), lambda h: h["url"]), "\n"
        ).alias("urls")
    )
    head = F.concat(F.lit("## Web Search for '"), F.col("query"), F.lit(f"' using {provider}\n\n"))
    body = F.coalesce(F.concat(F.col("urls"), F.lit("\n")), F.lit("No results found\n"))
    joined = asked.join(listed, "query", "left")
    return joined.select("query_ord", "query", F.concat(head, body).alias("out"))


def fetched_block(strip: bool) -> Column:
    """Block of a joined page, or the error block of one that is not in the table."""
    html = F.col("html")
    body = strip_html(html) if strip else html
    message = F.concat(F.lit("no page stored for "), F.col("url"))
    missing = page_error_block(F.col("url"), message, F.lit(""))
    notice = F.concat(F.lit("rate limit notice stored for "), F.col("url"))
    limited = page_error_block(F.col("url"), notice, F.lit(""))
    shown = page_block(page_title(html), F.col("url"), body)
    return F.when(html.isNull(), missing).when(rate_limit_seconds(html).isNotNull(), limited).otherwise(shown)


#: Before and after all times: captures without a time, and requests that take the newest.
NEVER, ALWAYS = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def newest_pages(pages: DataFrame, wanted: DataFrame, newest: Sequence[str]) -> DataFrame:
    """``(url, html)``: of the captures of each wanted URL the one with the greatest ``newest``, of equal ones one for sure.

    Pages meet the wanted URLs first, so that only their captures are compared, and are compared before they are shuffled.
    """
    found = pages.select("url", *newest, "html").join(wanted, "url")
    capture = F.struct(*newest, F.col("html").isNotNull().alias("__stored"), "html")
    return found.groupBy("url").agg(F.max(capture)["html"].alias("html"))


def captures_as_of(asked: DataFrame, pages: DataFrame, at: str, captured: str, newest: Sequence[str]) -> DataFrame:
    """``(url, at, html)``: for each different URL and time of ``asked`` the newest capture that is not after it.

    Times are settled on keys alone, by a union of captures and requests in the order of time; texts are then joined for
    the captures chosen. Captures without a time come before all others, requests without a time after them.
    """
    time = lambda c, else_: F.coalesce(F.col(c).cast("timestamp"), F.lit(else_).cast("timestamp"))
    requests = asked.select("url", time(at, ALWAYS).alias("__time")).distinct()
    urls = requests.select("url").distinct()
    stored = pages.withColumn("__time", time(captured, NEVER))
    capture = F.struct("__time", *newest)
    seen = stored.join(urls, "url").select("url", "__time", F.lit(0).alias("__kind"), capture.alias("__capture")).distinct()
    questions = requests.select("url", "__time", F.lit(1).alias("__kind"), F.lit(None).cast(seen.schema["__capture"].dataType).alias("__capture"))
    located = latest(seen.unionByName(questions), ["url"], ["__time", "__kind", "__capture"], "__capture", "__found")
    chosen = materialize(located.filter("__kind = 1 AND __found IS NOT NULL").select("url", F.col("__time").alias("__asked"), "__found"), "captures")
    keys = chosen.select("url", "__found").distinct()
    texts = join_keys(stored.select("url", capture.alias("__found"), "html"), keys, ["url", "__found"], "left_semi")
    text = F.max(F.struct(F.col("html").isNotNull().alias("__stored"), "html"))["html"]
    once = texts.groupBy("url", "__found").agg(text.alias("html"))
    return join_keys(chosen, once, ["url", "__found"]).select("url", "__asked", "html")


def page_get(
    requests: DataFrame,
    pages: DataFrame,
    strip: bool = False,
    at: str | None = None,
    captured: str | None = None,
    newest: Sequence[str] | None = None,
) -> DataFrame:
    """Pages of requested URLs from a crawl table; a URL without a page becomes an error block.

    Each request gives one row, however often its URL was crawled: the newest capture counts, by the columns ``newest``
    (``page_id`` where pages have it). With ``at``, a time of requests, and ``captured``, the time of pages, it is the
    newest capture that is not after the request, and a URL that was first crawled later is an error.

    ``status`` is ``ok``, ``error`` for a URL without a page, or ``limited`` for a stored rate-limit notice, which
    is shown as an error too. The requests are written out first, so that Spark knows their size when it plans:
    the pages are joined to the different URLs before anything else, and while these are small they are broadcast
    and the page table is not shuffled. Beyond that Spark shuffles both sides. The requests then meet the pages
    that were found, and a URL that is requested very often is split.
    """
    if newest is None:
        newest = [c for c in ("page_id",) if c in pages.columns]
    asked = materialize(requests, "requests")
    if at is None or captured is None:
        by_captured = [] if captured is None else [captured]
        found = newest_pages(pages, asked.select("url").distinct(), [*by_captured, *newest])
        joined = asked.join(found, "url", "left")
    else:
        found = captures_as_of(asked, pages, at, captured, newest)
        timed = asked.withColumn("__asked", F.coalesce(F.col(at).cast("timestamp"), F.lit(ALWAYS).cast("timestamp")))
        joined = timed.join(found, ["url", "__asked"], "left").drop("__asked")
    limited = rate_limit_seconds(F.col("html")).isNotNull()
    status = F.when(F.col("html").isNull(), "error").when(limited, "limited").otherwise("ok")
    return joined.withColumn("status", status).withColumn("out", fetched_block(strip)).drop("html")


def search_then_get(
    spark, queries: Sequence[str], hits: DataFrame, pages: DataFrame, strip: bool = False, provider: str = "Corpus"
) -> DataFrame:
    """Selected hits to report rows ``(query, ord, out)``: the section first, then one block per hit."""
    hits = materialize(hits, "hits")
    section = search_section(spark, queries, hits, provider).select("query", F.lit(0).alias("ord"), "out")
    blocks = page_get(hits.select("query", F.col("rank").alias("ord"), "url"), pages, strip)
    return section.unionByName(blocks.select("query", "ord", "out"))
