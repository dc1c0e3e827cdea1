import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import model
from marginalia.operators.criteria import exclude_by_table, match_files, match_pages
from marginalia.spec import Instruction

RULES = "ord long, criteria string, instruction string"


def matched(rows):
    return sorted(map(tuple, rows.select("id", "ord", "criteria", "instruction").collect()), key=repr)


@pytest.mark.parametrize("kind", ["files", "pages"])
def test_tables_equal_options(spark, kind):
    rng = random.Random(9)
    words = ["a", "b.c", "json", "example.org", "x/y", "", "example.org/en/long/path/of/many/words", "A", "."]
    texts = [".".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(300)]
    criteria = ["", "a", "A", "", "json", "example.org", "org", "c.json", ".", "example.org/en/long/path/of/many/words.a", *texts[:25]]
    rules = [(i, c, f"do {i}") for i, c in enumerate(criteria)]
    items = spark.createDataFrame([*enumerate(texts), (999, None), (0, texts[0])], "id long, v string")
    options = [Instruction(text, c) for _, c, text in rules]
    table = spark.createDataFrame([*rules, (5000, None, "never")], RULES)
    known = items.filter("v IS NOT NULL")
    for lower in (False, True) if kind == "pages" else (False,):
        if kind == "pages":
            want = model.match_rows(known, model.instructions_for_page(F.col("v"), options, lower), "id")
            got = match_pages(items, table, "v", lower)
        else:
            want = model.match_rows(known, model.instructions_for_file(F.col("v"), options), "id")
            got = match_files(items, table, "v")
        shown = [(r[0], r[1], r[3]) for r in matched(got)]
        assert sorted(shown) == sorted((r[0], r[1], r[3]) for r in matched(want)) and shown


def test_ten_thousand_criteria_without_a_nested_loop(spark):
    items = spark.range(20_000).select("id", F.concat(F.lit("http://h."), F.col("id").cast("string"), F.lit(".org/x.html")).alias("url"))
    rules = spark.range(10_000).select(F.col("id").alias("ord"), F.concat(F.col("id").cast("string"), F.lit(".org")).alias("criteria"), F.lit("go").alias("instruction"))
    rows = match_pages(items, rules)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows.count() == 10_000 and rows.filter("id != ord").count() == 0
    files = match_files(items, rules.withColumn("criteria", F.lit("html")).limit(3), "url")
    assert files.count() == 60_000


def test_ignore_lines_of_a_table(spark):
    paths = ["a/b/c.md", "a/b.md", "A/x.TXT", "b/c/d.tar.gz", "d", None, "ab/c.md"]
    files = spark.createDataFrame([(p,) for p in [*paths, "a/b.md"]], "path string")
    left = lambda *lines: sorted((r[0] or "" for r in exclude_by_table(files, spark.createDataFrame([(x,) for x in lines], "line string")).collect()))
    assert left("a/b/", " *.txt ", "D", "", None) == ["", "a/b.md", "a/b.md", "ab/c.md", "b/c/d.tar.gz"]
    assert left("*.gz", "*.tar.gz", "a/") == ["", "ab/c.md", "d"]
    assert len(left("nothing")) == 8
    with pytest.raises(ValueError, match="is a folder"):
        left("a*b")


def test_rules_that_share_criteria_meet_a_page_once_before_they_are_dealt(spark):
    from pyspark.sql import functions as F

    pages = spark.range(300).select("id", F.concat(F.lit("http://a.example.org/"), F.col("id").cast("string")).alias("url"))
    pages = pages.unionByName(pages.filter("id < 5"))
    rules = spark.range(200).select(F.col("id").alias("ord"), F.lit("example.org").alias("criteria"), F.lit("i").alias("instruction"))
    few = spark.createDataFrame([(1, "example.net", "n"), (2, "example.org/7", "s"), (2, "example.org/7", "s"), (3, "", "e")], "ord long, criteria string, instruction string")
    found = match_pages(pages, rules.unionByName(few))
    got = {r["criteria"]: r["count"] for r in found.groupBy("criteria").count().collect()}
    assert got == {"example.org": 305 * 200, "example.org/7": 2 * 11, "": 305}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan  # criteria of many rules are several keys
