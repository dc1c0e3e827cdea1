import pytest
from pyspark.sql import functions as F

from marginalia.functions import patterns
from marginalia.operators import select
from marginalia.spec import FileSpec

PATHS = ["a.md", "src/a.md", "src/x/B.MD", "src/x/y.txt", "src/xa/[1].c", "bin/tool", "src/bin/obj/f.cs", "deep/src/x/z.md"]


def taken(spark, glob):
    frame = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return [r["path"] for r in frame.filter(patterns.glob_match(F.col("path"), glob)).collect()]


@pytest.mark.parametrize(
    "glob, want",
    [
        ("**", PATHS),
        ("*.md", ["a.md"]),
        ("**/*.md", ["a.md", "src/a.md", "src/x/B.MD", "deep/src/x/z.md"]),
        ("**.md", ["a.md", "src/a.md", "src/x/B.MD", "deep/src/x/z.md"]),
        ("./src/*.md", ["src/a.md"]),
        ("src/../a.md", ["a.md"]),
        ("**/bin/", ["bin/tool", "src/bin/obj/f.cs"]),
        ("**/bin/**", ["bin/tool", "src/bin/obj/f.cs"]),
        ("src/x?/*", ["src/xa/[1].c"]),
        ("src/*/[1].c", ["src/xa/[1].c"]),
        ("src\\x\\*", ["src/x/B.MD", "src/x/y.txt"]),
        ("**/x/*.*", ["src/x/B.MD", "src/x/y.txt", "deep/src/x/z.md"]),
    ],
)
def test_globs(spark, glob, want):
    assert taken(spark, glob) == want


@pytest.mark.parametrize(
    "pattern, text, hit",
    [
        ("a{", "xa{y", True),
        ("a{2}", "caat", True),
        ("a{2,}b", "aaab", True),
        ("{x}", "a{x}", True),
        ("[a[b]", "[", True),
        ("[]x]", "]", True),
        ("[^]x]+$", "]]", False),
        ("[a&&b]", "&", True),
        ("^\\w+$", "é", True),
        ("(?i)É", "é", True),
        ("\\p{Lu}", "É", True),
        ("a$", "a\r", False),
        ("a$", "a\n", True),
        ("a.b", "a\rb", True),
        ("a.b", "a\nb", False),
        ("plain text", "some plain text", True),
        ("1.5", "1x5", True),
    ],
)
def test_pattern_dialect(spark, pattern, text, hit):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(patterns.matches(F.col("t"), pattern)).first()[0] is hit


def frame_of(spark):
    rows = [("a/one.md", "apple pear"), ("a/two.md", "apple"), ("b/two.txt", None), ("b/three.cs", "fig\npear")]
    return spark.createDataFrame(rows, "path string, text string")


def names(frame):
    return sorted(r["path"] for r in frame.collect())


def test_content_tests(spark):
    files = frame_of(spark)
    assert names(select.file_contains_all(files, ["apple", "p.ar"])) == ["a/one.md"]
    assert names(select.file_not_contains_any(files, ["pear"])) == ["a/two.md"]
    assert len(names(select.select_files(files, FileSpec()))) == 4


def test_exclusions(spark):
    files = frame_of(spark)
    assert names(select.exclude(files, ["two.*"])) == ["a/one.md", "b/three.cs"]
    assert names(select.exclude(files, ["one.m?", "b/"])) == ["a/two.md"]
    assert names(select.exclude(files, ["t.o"])) == ["a/one.md", "a/two.md", "b/three.cs", "b/two.txt"]
    assert names(select.ignore_rules(files, ["wo", "", "  ", "a/*.md"])) == ["b/three.cs"]
    excluded = files.filter("path like 'a/%'")
    assert names(select.exclude_paths(files, excluded)) == ["b/three.cs", "b/two.txt"]


def test_notices(spark):
    asks = [FileSpec(globs=("*.none",)), FileSpec(contains=("zebra",)), FileSpec(contains=("apple",))]
    got = [r["notice"] for r in select.no_match_notice(frame_of(spark), asks).orderBy("request").collect()]
    assert got == [
        "## Pattern: *.none\n\n - No files found\n",
        "## Pattern: **\n\n - No files matched criteria\n",
        None,
    ]


def test_wrap_decision(spark):
    one = spark.createDataFrame([("a.docx",)], "path string")
    convertible = F.col("path").endswith(".docx")
    assert select.wrap_decision(one, convertible).first()["wrap"] is False
    assert select.wrap_decision(one, convertible, single_command=False).first()["wrap"] is True
    assert {r["wrap"] for r in select.wrap_decision(one.union(one), convertible).collect()} == {True}


def test_keyword_order(spark):
    rows = [("b c", "x TERM"), ("z", "term"), ("a b", "none"), ("a Term c", "")]
    items = spark.createDataFrame(rows, "name string, body string")
    assert [r["name"] for r in select.keyword_find(items, "term", "name", "body").collect()] == ["z", "b c", "a Term c"]
