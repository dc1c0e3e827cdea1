"""Registered queries: HTML pages, search hits, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import htmltext
from ..functions.markdown import page_block as block
from ..functions.markdown import page_error_block
from ..operators import search
from ..operators.text_index import build_index, search_index
from ..plans.web import web_get, web_search
from ..plans.web import web_get_report as web_get_all
from ..spec import Instruction, SearchSpec
from . import inputs
from .model import _digest_sql, digest_model
from .registry import query

_ENTITIES = (
    ("&quot;", "'\"'"),
    ("&copy;", "chr(169)"),
    ("&middot;", "chr(183)"),
    ("&eacute;", "chr(233)"),
    ("&#233;", "chr(233)"),
    ("&#xE9;", "chr(233)"),
    ("&#128512;", "chr(128512)"),
    ("&lt;", "'<'"),
    ("&gt;", "'>'"),
    ("&nbsp;", "chr(160)"),
    ("&amp;", "'&'"),
)
EXTRA = " &eacute;&#233;&#xE9;&#128512;&nbsp;&lt;b&gt; &unknown; &#xD800; &amp;lt; & ;"


def _decoded(sql: str) -> str:
    for name, char in _ENTITIES:
        sql = f"replace({sql}, '{name}', {char})"
    return sql


_TAGS = "'<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>'"
_INNER = f"regexp_replace(html, {_TAGS}, '', 'gis')"
_KEPT_SCRIPT = "regexp_replace(html, '<script[^>]*>(.*?)</script>|<style[^>]*>(.*?)</style>|<!--.*?-->|<[^>]*>', '\\1\\2', 'gis')"
_WHITE = "' ' || chr(9) || chr(11) || chr(12) || chr(160) || chr(8203)"


def _collapsed(source: str, key: str) -> str:
    """CTEs from ``source(key, t)`` to ``collapsed(key, text)``: a line-by-line form."""
    return f"""numbered AS (
  SELECT {key}, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM (
    SELECT {key}, list_filter(string_split_regex(t, '[\\r\\n]'), lambda x: x <> '') AS l FROM {source})),
solid AS (
  SELECT {key}, line, i, lag(i, 1, 0) OVER (PARTITION BY {key} ORDER BY i) AS last_i
  FROM numbered WHERE trim(line, {_WHITE}) <> ''),
collapsed AS (
  SELECT s.{key}, coalesce(c.text, '') AS text FROM {source} s LEFT JOIN (
    SELECT {key}, string_agg(CASE WHEN i > last_i + 1 THEN chr(10) ELSE '' END || line, chr(10) ORDER BY i) AS text
    FROM solid GROUP BY {key}) c USING ({key}))"""


_STRIPPED = f"inner_text AS (SELECT page_id, {_decoded(_INNER)} AS t FROM pages), {_collapsed('inner_text', 'page_id')}"
_TITLE = f"trim(regexp_replace({_decoded(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1))')}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


def _pages(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages")


@query(f"WITH {_STRIPPED} SELECT page_id, text FROM collapsed")
def strip_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", htmltext.strip_html(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_KEPT_SCRIPT} AS text FROM pages")
def strip_html_scripts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", htmltext.inner_text(F.col("html"), drop_script=False).alias("text"))


@query(f"SELECT page_id, {_decoded('(html || ' + chr(39) + EXTRA + chr(39) + ')')} AS text FROM pages")
def decode_entities(spark, sf_dir):
    text = F.concat("html", F.lit(EXTRA))
    return _pages(spark, sf_dir).select("page_id", htmltext.decode_entities(text).alias("text"))


_REFERENCES = "&notit; &NotEqualTilde;&nang &copy2 &amp;lt; &ampamp; &#128;&#x81;&#0;&#xD800; &#65x &CounterClockwiseContourIntegral; &zwj;&nosuch;&;"
_SHOWN = "'¬it; ' || chr(8770) || chr(824) || '&nang ©2 &lt; &amp; €' || chr(129) || chr(65533) || chr(65533) || ' Ax ' || chr(8755) || ' ' || chr(8205) || '&nosuch;&;'"


@query(f"SELECT page_id, {_decoded(_INNER)} || ' ' || {_SHOWN} AS text FROM pages")
def decode_html5(spark, sf_dir):
    """The text of pages with all references of HTML5, with and without semicolon."""
    text = F.concat(htmltext.inner_text(F.col("html")), F.lit(" " + _REFERENCES))
    return _pages(spark, sf_dir).select("page_id", htmltext.decode_html5(text).alias("text"))


_SPACED = "(' ' || chr(10) || replace(replace(text, '. ', chr(10) || '  ' || chr(9) || chr(10) || chr(13) || chr(10) || chr(160) || chr(10)), ', ', chr(13) || chr(10) || chr(10)) || chr(10) || ' ')"


@query(f"WITH spaced AS (SELECT doc_id, {_SPACED} AS t FROM documents), {_collapsed('spaced', 'doc_id')} SELECT doc_id, text FROM collapsed")
def collapse_blanks(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(". "), F.lit("\n  \t\n\r\n\u00a0\n"))
    text = F.concat(F.lit(" \n"), F.replace(text, F.lit(", "), F.lit("\r\n\n")), F.lit("\n "))
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", htmltext.collapse_blanks(text).alias("text"))


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", htmltext.page_title(F.col("html")).alias("title"))


@query(
    f"""WITH found AS (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '<script[^>]*>.*?</script>|<!--.*?-->', '', 'gis'),
    '<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, unnest(generate_series(0, len(l) - 1))::INT AS pos, {_decoded('unnest(l)')} AS href FROM found"""
)
def page_links(spark, sf_dir):
    links = F.posexplode(htmltext.page_links(F.col("html"))).alias("pos", "href")
    return _pages(spark, sf_dir).select("page_id", links)


@query(
    f"""WITH {_STRIPPED}
SELECT page_id, '## ' || {_TITLE} || chr(10) || chr(10) || 'url: ' || url || chr(10) || chr(10) || '```' || chr(10) || text
  || chr(10) || '```' || chr(10) || chr(10) AS out FROM pages JOIN collapsed USING (page_id)"""
)
def page_block(spark, sf_dir):
    html = F.col("html")
    out = block(htmltext.page_title(html), F.col("url"), htmltext.strip_html(html))
    return _pages(spark, sf_dir).select("page_id", out.alias("out"))


@query(
    """SELECT page_id, '## Error fetching ' || url || chr(10) || chr(10) || 'status ' || (400 + page_id % 100) || chr(10) || 'at step ' || (page_id % 3) AS out
FROM pages"""
)
def page_errors(spark, sf_dir):
    message = F.concat(F.lit("status "), (400 + F.col("page_id") % 100).cast("string"))
    trace = F.concat(F.lit("at step "), (F.col("page_id") % 3).cast("string"))
    return _pages(spark, sf_dir).select("page_id", page_error_block(F.col("url"), message, trace).alias("out"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id::INT END AS wait_seconds FROM pages"""
)
def rate_limited_pages(spark, sf_dir):
    notice = F.concat(
        "html", F.lit("Rate limit is exceeded. Try again in "), F.col("page_id").cast("string"), F.lit(" seconds.")
    )
    content = F.when(F.col("page_id") % 3 == 0, notice).otherwise(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", htmltext.rate_limit_seconds(content).alias("wait_seconds"))


_SEARCHED = f"{_STRIPPED}, {inputs.VSEARCHED}"


@query(f"WITH {_SEARCHED} SELECT query, page_id, url FROM vsearched")
def corpus_search(spark, sf_dir):
    return inputs.searched(spark, sf_dir)


@query(
    f"""WITH {_SEARCHED}
SELECT query, page_id, url, row_number() OVER (PARTITION BY query ORDER BY page_id)::BIGINT AS pos FROM vsearched"""
)
def hit_positions(spark, sf_dir):
    return search.hit_positions(inputs.searched(spark, sf_dir))


# A query from the titles of pages: two words, or one that stands in no text, or a part of a word in capitals.
_ASKED = f"""asked AS (
  SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN w[1] || ' ' || w[-1] WHEN 1 THEN w[1] || ' ' || 'zq' || page_id || 'zq'
    WHEN 2 THEN upper(substr(w[-1], 2, 4)) ELSE w[2] || ' ' || w[3] || '  ' || substr(w[1], 1, 1) END AS query
  FROM (SELECT page_id, string_split({_TITLE}, ' ') AS w FROM pages WHERE page_id % 3 = 0))"""


@query(
    f"""WITH {_STRIPPED}, {_ASKED}, lowered AS (SELECT page_id, lower(text) AS body FROM collapsed)
SELECT query, page_id, url FROM asked, pages JOIN lowered USING (page_id)
WHERE query IS NOT NULL AND len(list_filter(string_split(lower(query), ' '), lambda t: NOT contains(body, t))) = 0"""
)
def indexed_search(spark, sf_dir):
    """A table of queries, made from the titles of pages, searched in an index of the text of all pages."""
    pages = inputs.page_text(spark, sf_dir)
    words, page_id = F.split(htmltext.page_title(F.col("html")), " "), F.col("page_id")
    word = lambda n: F.try_element_at(words, F.lit(n))
    absent = F.concat(F.lit("zq"), page_id.cast("string"), F.lit("zq"))
    query = (
        F.when(page_id % 4 == 0, F.concat(word(1), F.lit(" "), word(-1)))
        .when(page_id % 4 == 1, F.concat(word(1), F.lit(" "), absent))
        .when(page_id % 4 == 2, F.upper(F.substring(word(-1), 2, 4)))
        .otherwise(F.concat(word(2), F.lit(" "), word(3), F.lit("  "), F.substring(word(1), 1, 1)))
    )
    asked = inputs.table(spark, sf_dir, "pages").filter("page_id % 3 = 0").select(query.alias("query"))
    return search_index(build_index(pages), asked)


@query(
    """SELECT regexp_extract(url, '^[a-z]+') AS query, page_id AS "offset", i::INT AS pos,
  CASE i WHEN 0 THEN url ELSE url || '&again' END AS url FROM pages, (VALUES (0), (1)) v(i)"""
)
def response_hits(spark, sf_dir):
    url = F.col("url")
    general = F.concat(F.lit('{"webPages": {"value": [{"url": "'), url, F.lit('"}, {"url": "'), url, F.lit('&again"}]}}'))
    items = F.concat(F.lit('{"items": [{"link": "'), url, F.lit('", "rank": 1}, {"link": "'), url, F.lit('&again"}]}'))
    responses = _pages(spark, sf_dir).select(
        F.regexp_extract("url", "^[a-z]+", 0).alias("query"),
        F.col("page_id").alias("offset"),
        F.when(F.col("page_id") % 2 == 0, general).otherwise(items).alias("body"),
    )
    return search.response_hits(responses)


@query(
    f"""WITH {inputs.VREQUESTS}, bad AS (SELECT *, count(*) OVER (PARTITION BY request) AS n FROM vrequests WHERE NOT starts_with(url, 'http'))
SELECT request, ord, CASE WHEN n = 1 THEN 'Invalid URL: ' || url ELSE '  ' || url END AS line FROM bad
UNION ALL SELECT DISTINCT request, NULL::BIGINT, 'Invalid URLs:' FROM bad WHERE n > 1"""
)
def url_valid(spark, sf_dir):
    return search.invalid_requests(inputs.requests(spark, sf_dir))


@query(
    f"""WITH {inputs.VHITS}
SELECT query, pos, url FROM vhits WHERE starts_with(url, 'http') AND NOT regexp_matches(url, '(utm_source|/ref=)')
  AND NOT regexp_matches(url, '\\.html$') AND NOT contains(url, 'spam-farm')"""
)
def url_exclude(spark, sf_dir):
    return search.url_exclude(inputs.hits(spark, sf_dir), ["(utm_source|/ref=)", "\\.html$"], ["spam-farm"])


@query(f"WITH {inputs.VHITS} SELECT query, url, min(pos)::BIGINT AS pos FROM vhits GROUP BY query, url")
def dedup_first(spark, sf_dir):
    return search.dedup_first(inputs.hits(spark, sf_dir))


_TOP = f"""{inputs.VHITS},
firsts AS (SELECT query, url, min(pos)::BIGINT AS pos FROM vhits WHERE starts_with(url, 'http') AND NOT contains(url, 'utm_source') GROUP BY ALL),
top AS (SELECT query, url, pos, row_number() OVER (PARTITION BY query ORDER BY pos)::INT AS rank FROM firsts QUALIFY rank <= 10)"""


@query(f"WITH {_TOP} SELECT query, url, pos, rank FROM top")
def top_n_per_query(spark, sf_dir):
    return search.select_hits(inputs.hits(spark, sf_dir), 10, ["utm_source"])


_SECTION = f"""section AS (
  SELECT q.query, '## Web Search for ''' || q.query || ''' using Corpus' || chr(10) || chr(10)
    || coalesce((SELECT string_agg(url, chr(10) ORDER BY rank) FROM top t WHERE t.query = q.query) || chr(10), 'No results found' || chr(10)) AS out
  FROM (VALUES ('the '), ('le '), ('der '), ('no such words anywhere')) q(query))"""


@query(f"WITH {_TOP}, {_SECTION} SELECT query, out FROM section")
def search_section(spark, sf_dir):
    top = search.select_hits(inputs.hits(spark, sf_dir), 10, ["utm_source"])
    return search.search_section(spark, inputs.HIT_QUERIES, top).select("query", "out")


def _block_sql(body: str) -> str:
    return f"""'## ' || {_TITLE} || chr(10) || chr(10) || 'url: ' || url || chr(10) || chr(10) || '```' || chr(10) || {body}
  || chr(10) || '```' || chr(10) || chr(10)"""


@query(
    f"""WITH {_TOP}, {_SECTION}, {_STRIPPED}
SELECT query, 0 AS ord, out FROM section UNION ALL
SELECT query, rank, {_block_sql('text')} FROM top JOIN pages USING (url) JOIN collapsed USING (page_id)"""
)
def search_then_get(spark, sf_dir):
    top = search.select_hits(inputs.hits(spark, sf_dir), 10, ["utm_source"])
    return search.search_then_get(spark, inputs.HIT_QUERIES, top, _pages(spark, sf_dir), strip=True)


_NO_PAGE = "'## Error fetching ' || r.url || chr(10) || chr(10) || 'no page stored for ' || r.url || chr(10)"


@query(
    f"""WITH asked AS (SELECT page_id AS ord, CASE WHEN page_id % 3 = 0 THEN url || '&missing' ELSE url END AS url FROM pages)
SELECT ord, r.url, CASE WHEN page_id IS NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN page_id IS NULL THEN {_NO_PAGE} ELSE {_block_sql('html').replace('|| url ||', '|| r.url ||')} END AS out
FROM asked r LEFT JOIN pages p ON r.url = p.url"""
)
def page_get(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    lost = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("&missing"))).otherwise(F.col("url"))
    asked = pages.select(F.col("page_id").alias("ord"), lost.alias("url"))
    return search.page_get(asked, pages).select("ord", "url", "status", "out")


DAY, CRAWLED = 86400, 1700000000
_CAPTURES = f"""captures AS (
  SELECT url, page_id, to_timestamp({CRAWLED} + (page_id % 5) * {DAY}) AS captured, html FROM pages
  UNION ALL SELECT url, page_id, to_timestamp({CRAWLED} + (10 + page_id % 4) * {DAY}), html || ' later' FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT url, page_id + 1000000, to_timestamp({CRAWLED} + (10 + page_id % 4) * {DAY}), html || ' again' FROM pages WHERE page_id % 6 = 0
  UNION ALL SELECT 'http://hot.example/', page_id, to_timestamp({CRAWLED} + page_id), '<title>hot</title>' || page_id FROM pages),
asked AS (
  SELECT page_id AS ord, CASE WHEN page_id % 7 = 1 THEN 'http://hot.example/' ELSE url END AS url,
         to_timestamp({CRAWLED} + (page_id % 17 - 1) * {DAY} + page_id) AS asked_at FROM pages)"""


def _captures(spark, sf_dir):
    pages, page_id = _pages(spark, sf_dir), F.col("page_id")
    crawled = lambda day: F.timestamp_seconds(F.lit(CRAWLED) + day * DAY).alias("captured")
    html = lambda mark: F.concat("html", F.lit(mark)).alias("html")
    later = crawled(10 + page_id % 4)
    hot = F.concat(F.lit("<title>hot</title>"), page_id.cast("string")).alias("html")
    captures = pages.select("url", "page_id", crawled(page_id % 5), "html")
    captures = captures.union(pages.filter("page_id % 3 = 0").select("url", "page_id", later, html(" later")))
    captures = captures.union(pages.filter("page_id % 6 = 0").select("url", page_id + 1000000, later, html(" again")))
    captures = captures.union(pages.select(F.lit("http://hot.example/"), page_id, F.timestamp_seconds(F.lit(CRAWLED) + page_id), hot))
    at = F.timestamp_seconds(F.lit(CRAWLED) + (page_id % 17 - 1) * DAY + page_id).alias("at")
    url = F.when(page_id % 7 == 1, F.lit("http://hot.example/")).otherwise(F.col("url")).alias("url")
    return captures, pages.select(page_id.alias("ord"), url, at)


def _captured_sql(latest: str) -> str:
    return f"""WITH {_CAPTURES},
chosen AS (SELECT a.ord, a.url, max_by(html, (captured, page_id)) AS html FROM asked a LEFT JOIN captures c ON a.url = c.url{latest} GROUP BY ALL)
SELECT ord, r.url, CASE WHEN html IS NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN html IS NULL THEN {_NO_PAGE} ELSE {_block_sql('html').replace('|| url ||', '|| r.url ||')} END AS out FROM chosen r"""


@query(_captured_sql(" AND captured <= asked_at"))
def page_get_as_of(spark, sf_dir):
    """Pages as they were when they were asked for, from several captures of a URL, one of them very hot."""
    captures, asked = _captures(spark, sf_dir)
    return search.page_get(asked, captures, at="at", captured="captured").select("ord", "url", "status", "out")


@query(_captured_sql(""))
def page_get_newest(spark, sf_dir):
    """One block per request, of the newest of several captures."""
    captures, asked = _captures(spark, sf_dir)
    return search.page_get(asked.drop("at"), captures, captured="captured").select("ord", "url", "status", "out")


@query(
    f"""WITH {inputs.VREQUESTS}, {_STRIPPED},
good AS (SELECT * FROM vrequests WHERE request NOT IN (SELECT request FROM vrequests WHERE NOT starts_with(url, 'http')))
SELECT request, ord, {_block_sql('text')} AS out FROM good JOIN pages USING (url) JOIN collapsed USING (page_id)"""
)
def web_get_report(spark, sf_dir):
    rows = web_get(inputs.requests(spark, sf_dir), _pages(spark, sf_dir), strip=True)
    return rows.select("request", "ord", "out")


@query(
    f"""WITH {_SEARCHED},
top AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY page_id)::INT AS rank FROM vsearched
  WHERE NOT regexp_matches(url, '(?i)SPAM') QUALIFY rank <= 5),
section AS (SELECT q.query, '## Web Search for ''' || q.query || ''' using Corpus' || chr(10) || chr(10)
    || coalesce((SELECT string_agg(url, chr(10) ORDER BY rank) FROM top t WHERE t.query = q.query) || chr(10), 'No results found' || chr(10)) AS out
  FROM (SELECT DISTINCT query FROM terms) q)
SELECT query, 0 AS ord, out FROM section UNION ALL
SELECT query, rank, {_block_sql('text')} FROM top JOIN pages USING (url) JOIN collapsed USING (page_id)"""
)
def web_search_report(spark, sf_dir):
    spec = SearchSpec(max_results=5, exclude_urls=("(?i)SPAM",), get_content=True, strip=True)
    hits = inputs.searched(spark, sf_dir)
    return web_search(spark, inputs.TERM_QUERIES, hits, _pages(spark, sf_dir), spec, order=["page_id"])


_EDGES = (
    "<body><script-loader>keep</script-loader><!-- <title>no</title><a href='no'>n</a> --><svg><title>drawn</title></svg>"
    "<title>Page &#0000000000065;&#x00041;</title><a-card href='no'>c</a-card><a data-href='no' href='one'>1</a>"
    "<a title='a > b' href='two'>2</a></body>"
)


@query(
    f"""WITH lined AS (SELECT page_id, regexp_replace(html, '(?is)<title[^>]*>.*?</title>', '') AS html FROM pages),
body AS (SELECT page_id, {_INNER} AS t, html FROM lined),
found AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<script[^>]*>.*?</script>|<!--.*?-->', '', 'gis'), '<a\\s[^>]*href="([^"]*)"', 1) AS l FROM lined)
SELECT page_id, 'Page AA' AS title, 'keepdrawnPage AAc12' || {_decoded('t')} AS text, len(l) + 2 AS n_links FROM body JOIN found USING (page_id)"""
)
def html_edges(spark, sf_dir):
    """Pages with custom tags, hidden titles, attributes that only look like links, and padded entities."""
    html = F.concat(F.lit(_EDGES), F.regexp_replace("html", "(?is)<title[^>]*>.*?</title>", ""))
    text = htmltext.decode_entities(htmltext.inner_text(html))
    return _pages(spark, sf_dir).select(
        "page_id", htmltext.page_title(html).alias("title"), text.alias("text"), F.size(htmltext.page_links(html)).cast("bigint").alias("n_links")
    )


@query(
    f"""WITH {inputs.VHITS}, firsts AS (SELECT query, url FROM vhits GROUP BY query, url)
SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY url)::INT AS rank FROM firsts QUALIFY rank <= 1500"""
)
def top_many_by_name(spark, sf_dir):
    """More hits per query than a window limit takes, ordered by a string."""
    hits = inputs.hits(spark, sf_dir).select("query", "url").distinct()
    return search.top_n_per_query(hits, 1500, ["url"])


@query(
    f"""WITH {inputs.VREQUESTS}, {_STRIPPED},
bad AS (SELECT *, count(*) OVER (PARTITION BY request) AS n FROM vrequests WHERE NOT starts_with(url, 'http')),
good AS (SELECT * FROM vrequests WHERE request NOT IN (SELECT request FROM bad)),
blocks AS (SELECT request, ord, url, {_block_sql('text')} AS out FROM good JOIN pages USING (url) JOIN collapsed USING (page_id))
SELECT request, ord, CASE WHEN contains(url, '.example.net') THEN {_digest_sql('out', "'Find the author'", "repeat('`', 7)")} ELSE out END AS out FROM blocks
UNION ALL SELECT request, ord, CASE WHEN n = 1 THEN 'Invalid URL: ' || url ELSE '  ' || url END FROM bad
UNION ALL SELECT DISTINCT request, NULL::BIGINT, 'Invalid URLs:' FROM bad WHERE n > 1"""
)
def web_get_messages(spark, sf_dir):
    """Requested pages with an instruction for some sites, and the messages of rejected lists."""
    rules = (Instruction("Find the author", "example.net"),)
    asked = inputs.requests(spark, sf_dir)
    return web_get_all(asked, _pages(spark, sf_dir), strip=True, instructions=rules, build_model=digest_model)


@query(
    f"""WITH {_STRIPPED}, lowered AS (SELECT page_id, lower(text) AS body FROM collapsed),
terms AS (SELECT query, unnest(string_split(lower(query), ' ')) AS term
  FROM (VALUES ('Nation the'), ('le de'), ('der die das'), ('no such words anywhere')) q(query))
SELECT query, page_id, url FROM pages JOIN lowered USING (page_id), terms GROUP BY query, page_id, url HAVING bool_and(contains(body, term))"""
)
def text_search(spark, sf_dir):
    """Terms in the text of pages, where tags and attributes are no hits."""
    pages = _pages(spark, sf_dir).withColumn("text", htmltext.strip_html(F.col("html")))
    return search.corpus_search(pages, inputs.TERM_QUERIES, "text")
