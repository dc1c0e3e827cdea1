import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import htmltext, paths
from marginalia.operators import names, search

WHITE = " \t\x0b\x0c ​"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def collapsed(text):
    rows = [r for r in re.split("[\r\n]", text) if r]
    solid = [i for i, r in enumerate(rows) if r.strip(WHITE)]
    out = []
    for at, i in enumerate(solid):
        last = solid[at - 1] if at else -1
        out += ([""] if i > last + 1 else []) + [rows[i]]
    return "\n".join(out)


def test_collapse_blanks_on_random_texts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", " ", "\n", "\n", "\r\n", " ", "\t", "​", "b c"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts += ["", "\n", " ", " \n ", "a\n \n \n  x\n "]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in frame.select("i", htmltext.collapse_blanks(F.col("t")).alias("c")).collect():
        assert r["c"] == collapsed(texts[r["i"]]), repr(texts[r["i"]])


def test_collapse_blanks_on_long_white_runs(spark):
    assert one(spark, "a" + "\n " * 100000 + "\nb", htmltext.collapse_blanks) == "a\n\nb"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a</p>b", "ab"),
        ("a <b title='x>y'>c</b>", "a c"),
        ('<a href="x" title="1 > 2">go</a>', "go"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("a<!-- <p>no</p> -->b<!-- open", "ab"),
        ("<script>if (a < b) { x('</p>') }</script>z", "z"),
        ("<STYLE type='t'>p {}</STYLE >z<br/>y", "zy"),
        ("<!DOCTYPE html><?xml v?>t", "t"),
    ],
)
def test_inner_text(spark, html, text):
    assert one(spark, html, htmltext.inner_text) == text


def test_scripts_can_stay(spark):
    html = "<script>a('</p>') < b</script>z<i>y</i>"
    assert one(spark, html, lambda c: htmltext.inner_text(c, drop_script=False)) == "a('</p>') < bzy"


def test_entities(spark):
    from html.entities import name2codepoint

    every = " ".join(f"&{name};" for name in name2codepoint)
    assert one(spark, every, htmltext.decode_entities) == " ".join(map(chr, name2codepoint.values()))
    kept = "&nosuch; &amp &#xD800; &#1114112; &#99999999999; a&b; & ;"
    assert one(spark, kept, htmltext.decode_entities) == kept
    assert one(spark, "&amp;lt; &#x1F600;&#65;&apos;", htmltext.decode_entities) == "&lt; \U0001f600A'"
    assert one(spark, "&lt;&amp;gt;&nbsp;", htmltext.decode_core_entities) == "<&gt; "


def test_titles_and_links(spark):
    html = "<html><title lang='x'> A &amp;\n B </title><!-- <a href='no'>--><a class=c href=plain>1</a><A HREF='q?a&amp;b'>2</A><a>3</a><a href=\"\">4</a><link href='no2'>"
    assert one(spark, html, htmltext.page_title) == "A & B"
    assert one(spark, html, htmltext.page_links) == ["plain", "q?a&b", ""]
    assert one(spark, "no title", htmltext.page_title) == ""


def test_rate_limit(spark):
    say = "x Rate limit is exceeded. Try again in {} seconds. y"
    assert one(spark, say.format(12), htmltext.rate_limit_seconds) == 12
    assert one(spark, say.format("some"), htmltext.rate_limit_seconds) is None
    assert one(spark, "Try again in 3 seconds.", htmltext.rate_limit_seconds) is None


@pytest.mark.parametrize(
    "url, slug",
    [
        ("https://Example.com/", "example-com"),
        ("http://me@example.com:8080/a/b.html?x=1&y=%20#frag", "example-com-a-b-html-x-1-y-20"),
        ("https://example.com/é/z", "example-com-C3-A9-z"),
    ],
)
def test_url_slug(spark, url, slug):
    assert one(spark, url, paths.url_slug) == slug


def test_unique_slugs_of_one_hot_name(spark):
    rows = [(i, f"http://h.org/a{'#' if i % 2 else '/'}{'' if i % 2 == 0 else i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = [r["name"] for r in names.unique_slug(pages, "out").collect()]
    assert len(set(got)) == 300 and "out/h-org-a" in got and all(n.startswith("out/h-org-a") for n in got)


HITS = [("q", p, u) for p, u in enumerate(["http://a", "ftp://x", "http://b", "http://a", "http://own.se/z", "http://c"], 1)]


def test_hit_selection(spark):
    hits = spark.createDataFrame(HITS, "query string, pos long, url string")
    got = search.select_hits(hits, 2, ["b$"], ["own.se"]).orderBy("rank").collect()
    assert [(r["url"], r["pos"], r["rank"]) for r in got] == [("http://a", 1, 1), ("http://c", 6, 2)]


def test_top_n_limits_before_the_shuffle(spark, capsys):
    search.top_n_per_query(spark.createDataFrame(HITS, "query string, pos long, url string"), 3).explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_requests(spark):
    rows = [(1, 0, "http://a"), (1, 1, "x.org"), (2, 0, "y"), (2, 1, "z"), (3, 0, "http://b")]
    asked = spark.createDataFrame(rows, "request int, ord int, url string")
    lines = {(r["request"], r["ord"]): r["line"] for r in search.invalid_requests(asked).collect()}
    assert lines == {(1, 1): "Invalid URL: x.org", (2, None): "Invalid URLs:", (2, 0): "  y", (2, 1): "  z"}
    assert [r["url"] for r in search.accepted_requests(asked).collect()] == ["http://b"]


def test_missing_page_becomes_an_error_block(spark):
    pages = spark.createDataFrame([("http://a", "<title>T</title><p>x")], "url string, html string")
    asked = spark.createDataFrame([(0, "http://a"), (1, "http://gone")], "ord int, url string")
    got = {r["ord"]: (r["status"], r["out"]) for r in search.page_get(asked, pages, strip=True).collect()}
    assert got[0] == ("ok", "## T\n\nurl: http://a\n\n```\nTx\n```\n\n")
    assert got[1][0] == "error" and got[1][1].startswith("## Error fetching http://gone\n\n")


def test_responses_of_both_shapes(spark):
    rows = [
        ("q", 50, '{"webPages": {"value": [{"url": "u1", "name": "n"}, {"url": "u2"}]}}'),
        ("q", 100, '{"items": [{"link": "u3"}]}'),
        ("q", 150, '{"items": []}'),
        ("q", 200, "not json"),
    ]
    hits = search.response_hits(spark.createDataFrame(rows, "query string, offset int, body string"))
    assert [r["url"] for r in hits.orderBy("offset", "pos").collect()] == ["u1", "u2", "u3"]


def test_very_many_hits_are_ranked(spark):
    hits = spark.range(0, 300000, 1, 8).select(F.lit("q").alias("query"), F.col("id").alias("pos"))
    top = search.top_n_per_query(hits, 150000)
    got = top.agg(F.count("rank").alias("n"), F.max("rank").alias("r"), F.max("pos").alias("p")).first()
    assert tuple(got) == (150000, 150000, 149999)
    named = hits.withColumn("pos", F.lpad(F.col("pos").cast("string"), 9, "0"))
    for n in (3, 2000):
        got = [(r["rank"], int(r["pos"])) for r in search.top_n_per_query(named, n).orderBy("rank").collect()]
        assert got == [(i + 1, i) for i in range(n)]


def test_few_urls_leave_the_page_table_unshuffled(spark, tmp_path):
    spark.range(20000).select(F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("<p>x"), 50).alias("html")).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    asked = spark.createDataFrame([(i, f"http://h/{i * 3000}") for i in range(10)], "ord int, url string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        got = search.page_get(asked, pages)
        assert sorted((r["ord"], r["status"]) for r in got.collect()) == [(i, "ok" if i < 7 else "error") for i in range(10)]
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        above = plan.split("FileScan parquet [url")[0]
        lines = plan.split("\n")
        scan = next(i for i, line in enumerate(lines) if "html" in line and "FileScan" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        climb, at = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < at:
                climb.append(line)
                at = depth(line)
        joins = [i for i, line in enumerate(climb) if "Join" in line]
        assert "BroadcastHashJoin" in climb[joins[0]] and not any("Exchange" in line for line in climb[: joins[0]]) and above
        many = spark.range(20000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("http://h/"), "id").alias("url"))
        assert search.page_get(many, pages).filter("status = 'ok'").count() == 20000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_boundaries_of_tags_and_attributes(spark):
    html = (
        "x<script-loader>keep</script-loader>y<script>a</script><styled-box>z</styled-box><!-- <title>no</title> -->"
        "<svg><title>drawing</title></svg><title>Yes</title><a-card href='no'>c</a-card><a data-href='no' href='one'>1</a>"
        "<a title='a > b' href=two>2</a><a rel=x/href='no'>3</a><a\nhref = \"three\">4</a><abbr href='no'>"
    )
    assert one(spark, html, htmltext.inner_text) == "xkeepyzdrawingYesc1234"
    assert one(spark, html, htmltext.page_title) == "Yes"
    assert one(spark, html, htmltext.page_links) == ["one", "two", "three"]


def test_numeric_entities_with_leading_zeros(spark):
    assert one(spark, "&#0000000000065;&#x000000041;&#X0041;&#00000000000000000001114112;", htmltext.decode_entities) == (
        "AAA&#00000000000000000001114112;"
    )


def test_rate_limit_notices_are_errors(spark):
    pages = spark.createDataFrame([("http://a", "Rate limit is exceeded. Try again in 7 seconds.")], "url string, html string")
    row = search.page_get(spark.createDataFrame([(0, "http://a")], "ord int, url string"), pages).first()
    assert row["status"] == "limited" and row["out"].startswith("## Error fetching http://a\n\nrate limit notice")


def test_repeated_captures_give_one_block(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    stored = [("http://a", 1, day(1), "one"), ("http://a", 2, day(3), "two"), ("http://a", 3, day(3), "three"), ("http://a", 3, day(3), "tree"),
              ("http://b", 4, None, "old"), ("http://b", 5, day(9), "new"), ("http://n", 6, day(1), None)]
    pages = spark.createDataFrame(stored, "url string, page_id long, captured string, html string")
    asked = [(0, "http://a", day(2)), (1, "http://a", day(3)), (2, "http://a", None), (3, "http://b", day(2)), (4, "http://b", day(9)),
             (5, "http://a", "2023-12-31 00:00:00"), (6, "http://a", day(2)), (7, "http://n", day(2)), (8, None, day(2))]
    requests = spark.createDataFrame(asked, "ord int, url string, at string").repartition(4)
    got = {r["ord"]: (r["status"], r["out"]) for r in search.page_get(requests, pages, at="at", captured="captured").collect()}
    assert len(got) == len(asked)
    text = lambda n: got[n][1].split("```\n")[1].strip() if got[n][0] == "ok" else got[n][0]
    assert [text(n) for n in range(9)] == ["one", "tree", "tree", "old", "new", "error", "one", "error", "error"]
    newest = {r["ord"]: r["out"] for r in search.page_get(requests.drop("at"), pages).collect()}
    assert len(newest) == len(asked) and "tree" in newest[0] and "new" in newest[3]


def test_a_hot_url_is_cut_into_ranges(spark):
    from marginalia.operators.ordered import latest

    rows = spark.range(40_000, numPartitions=8).select(
        F.lit("hot").alias("url"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v")
    )
    got = latest(rows, ["url"], ["t"], "v", "last")
    assert got.filter(~F.col("last").eqNullSafe(F.when(F.col("t") >= 7, F.floor((F.col("t") - 7) / 1000) * 1000 + 7))).count() == 0
    assert got.count() == 40_000


def test_html5_references_equal_unescape(spark):
    from html import unescape
    from html.entities import html5

    rng = random.Random(12)
    names = sorted(html5)
    texts = [f"x&{name}y" for name in names] + [f"&{name} " for name in names]
    texts += [f"&#{n};" for n in [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**12]]
    texts += [f"&#{c}{n:{w}x}{e}" for c in "xX" for n in (0, 9, 11, 65, 0x80, 0x81, 0x9F, 0x2028, 0x1F600) for w in ("", "012") for e in (";", "", "g")]
    parts = ["&", "#", "x", ";", "amp", "lt", "not", "notin", "copy", "CounterClockwiseContourIntegral", "a", " ", "\n", "1", "65", "é", "<", "\t", "🙂"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", htmltext.decode_html5(F.col("v")).alias("got")).collect()
    assert [(r["v"], r["got"]) for r in rows if r["got"] != unescape(r["v"])] == []
