import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions.markdown import fence_choice
from marginalia.operators import line_rows, lines, numbering
from marginalia.spec import FileSpec, LineSpec

WORDS = "Alfa Bravo Cobra Delta Echo Fox Golf Hotel India Juliet".split()
LETTERS = "# Letters\n\n" + "\n".join(f"{w[0]} - {w}" for w in WORDS)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def expected(text, spec, ticks="```"):
    """The report of one text by plain loops over line numbers."""
    rows = text.split("\n")
    gone = [any(re.search(p, r) for p in spec.remove) for r in rows]
    hit = [all(re.search(p, r) for p in spec.include) and not g for r, g in zip(rows, gone)]
    kept = [i for i in range(len(rows)) if any(hit[max(0, i - spec.after) : i + spec.before + 1])]
    out = []
    for at, i in enumerate(kept):
        if spec.has_context and at and kept[at - 1] != i - 1:
            out.append((i, 0, ticks + "\n\n" + ticks))
        if spec.numbers:
            out.append((i, 1, f"{i + 1}:" if gone[i] else f"{i + 1}: {rows[i]}"))
        elif not gone[i]:
            out.append((i, 1, rows[i]))
    return out


def report(spark, text, spec):
    return lines.grep_report(docs(spark, text), spec).first()["report"]


@pytest.mark.parametrize(
    "spec, shown",
    [
        (LineSpec.around(2, include=("E - Echo",)), "C - Cobra\nD - Delta\nE - Echo\nF - Fox\nG - Golf"),
        (LineSpec(include=("B - Bravo",), after=2), "B - Bravo\nC - Cobra\nD - Delta"),
        (LineSpec(include=("E - Echo",), before=2), "C - Cobra\nD - Delta\nE - Echo"),
        (LineSpec(include=("nothing like it",), before=2), ""),
    ],
)
def test_context(spark, spec, shown):
    assert report(spark, LETTERS, spec) == shown


def test_removed_lines_and_numbers(spark):
    text = report(spark, LETTERS, LineSpec(remove=("Cobra", "Delta")))
    assert "B - Bravo\nE - Echo" in text and "Cobra" not in text and "Delta" not in text
    numbered = docs(spark, LETTERS).select(lines.number_lines(F.col("text"))).first()[0]
    assert numbered.startswith("1: # Letters\n2: \n3: A - Alfa\n4: B - Bravo")
    spec = LineSpec(include=("Bravo",), remove=("Cobra",), after=2, numbers=True)
    assert report(spark, LETTERS, spec) == "4: B - Bravo\n5:\n6: D - Delta"


def test_gap_after_a_dropped_line(spark):
    spec = LineSpec(include=("x",), remove=("no",), after=1)
    assert report(spark, "x\nno\na\nx\nb", spec) == "x\n```\n\n```\nx\nb"


def test_carriage_return_and_last_empty_line(spark):
    rows = line_rows.split_lines(docs(spark, "a\r\nb\n")).orderBy("idx").collect()
    assert [(r["idx"], r["line"]) for r in rows] == [(0, "a\r"), (1, "b"), (2, "")]
    assert report(spark, "a\r\nb", LineSpec(include=("a$",))) == ""
    assert report(spark, "a\r\nb", LineSpec(include=("a.$",))) == "a\r"


@pytest.mark.parametrize("numbers", [True, False])
@pytest.mark.parametrize("before, after, stretch", [(0, 0, 4), (1, 2, 5), (3, 0, 4), (0, 4, 6), (2, 2, 1 << 16)])
def test_random_texts_both_forms(spark, before, after, numbers, stretch):
    rng = random.Random(before * 100 + after * 10 + numbers)
    texts = ["\n".join(rng.choice(["hit", "hit no", "no", "", "other", "more"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    spec = LineSpec(include=("h.t",), remove=("no",), before=before, after=after, numbers=numbers)
    frame = docs(spark, *texts)
    got = {r["doc_id"]: r["report"] for r in lines.grep_report(frame, spec).collect()}
    rows = line_rows.grep_rows(line_rows.split_lines(frame), spec, stretch=stretch).collect()
    for i, text in enumerate(texts):
        want = expected(text, spec)
        assert got[i] == "\n".join(w[2] for w in want)
        mine = sorted((r["idx"], r["piece"], r["out"]) for r in rows if r["doc_id"] == i)
        assert mine == want


def test_numbering_over_slices_of_a_hot_key(spark):
    rng = random.Random(5)
    data = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", i * 3, rng.random() < 0.3) for i in range(2000)]
    frame = spark.createDataFrame(data, "key string, at long, flag boolean").repartition(7)
    placed = numbering.numbered(frame, ["key"], [F.col("at")], F.expr("at div 100"), "n")
    sliced = frame.withColumn("slice", F.expr("at div 100"))
    counted = numbering.running_count(sliced, ["key"], [F.col("at")], "slice", F.col("flag"), "n")
    got = {(r["key"], r["at"]): r["n"] for r in placed.collect()}
    runs = {(r["key"], r["at"]): r["n"] for r in counted.collect()}
    seen, flags = {}, {}
    for key, at, flag in sorted(data, key=lambda d: d[1]):
        seen[key] = seen.get(key, 0) + 1
        flags[key] = flags.get(key, 0) + flag
        assert got[key, at] == seen[key] and runs[key, at] == flags[key]
    assert len(got) == len(runs) == 2000


def test_containing_uses_patterns_at_both_levels():
    spec = FileSpec.containing("a", "b", lines=LineSpec(include=("c",), before=1))
    assert spec.contains == ("a", "b") and spec.lines.include == ("c", "a", "b") and spec.lines.before == 1


def test_gap_uses_the_fitted_fence(spark):
    frame = docs(spark, "x ```` y\nb\nc\nx").withColumn("path", F.lit("a.md"))
    ticks = fence_choice(F.col("path"), F.col("text"))
    spec = LineSpec(include=("x",), after=1)
    assert lines.grep_report(frame, spec, ticks=ticks).first()["report"] == "x ```` y\nb\n`````\n\n`````\nx"


def test_negative_context_is_refused():
    with pytest.raises(ValueError):
        LineSpec(before=-1)


@pytest.mark.parametrize(
    "pattern, text",
    [
        ("plain", "plain"), ("a[^b]cde", "cde"), ("(?i)abc", None), ("abc|def", None), ("^abc$", "abc"), ("abc*", "ab"),
        ("abc+d", "abc"), ("ab{2}cd", "cd"), ("x(abc)?yz", "yz"), ("(abc|def)gh", None), ("\\bword\\b", "word"),
        ("a\\.b", "a.b"), ("[]ab]cd", "cd"), ("[^]ab]cd", "cd"), ("[a\\]b]cd", "cd"), ("a.b", None), ("\\Qab\\E", None),
        ("(?<n>ab)cd", "cd"), ("", ""), ("(?=ab)cd?e", None), ("\\d+ items", " items"), ("a{2,}bc", "bc"), ("\\p{Lu}x", None),
        ("\\x{41}bc", "bc"), ("{ab}cd", "cd"),
    ],
)
def test_text_a_pattern_needs(pattern, text):
    from marginalia.functions.patterns import required_text

    assert required_text(pattern) == text


@pytest.mark.parametrize("pattern", ["^b", "b$", "a b", "[^a]b", "\\bb", "(?<=x)b", "b++", "a.b", "a b c?", "(a b)+", "a(?: b)"])
def test_lines_found_with_any_kind_of_pattern(spark, pattern):
    texts = ["a b\nb", "xb\nb a", "a\nb", "axb", "", "ab\na b c\nb"]
    spec = LineSpec(include=(pattern,), before=1)
    got = {r["doc_id"]: r["report"] for r in lines.grep_report(docs(spark, *texts), spec).collect()}
    for i, text in enumerate(texts):
        assert got[i] == "\n".join(w[2] for w in expected(text, spec)), text


def test_streamed_lines_equal_lines_at_rest(spark, tmp_path):
    from marginalia.operators import line_rows
    from marginalia.streaming import grep
    from marginalia.streaming.lines import stream_context, stream_lines

    rng = random.Random(13)
    lines = [(doc, i, rng.choice(["hit", "plain", "gone", "hit gone", ""])) for doc in range(6) for i in range(rng.randint(1, 60))]
    schema = "doc_id long, idx long, line string"
    rest = spark.createDataFrame(lines, schema)
    rng.shuffle(lines)
    cuts = [lines[at : at + 25] for at in range(0, len(lines), 25)]
    folder = str(tmp_path / "in")
    for cut in [*cuts, cuts[0]]:  # the first one comes again
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(folder)
    specs = [LineSpec(("hit",), ("gone",), 2, 3, True), LineSpec(("hit",), (), 0, 1), LineSpec(("hit",), (), 3, 0), LineSpec(("hit",))]
    for at, spec in enumerate(specs):
        arriving = grep.read_documents(spark, folder, rest.schema, files_per_batch=2)
        for name, run, want in (
            ("pieces", stream_lines(arriving, spec), line_rows.grep_rows(rest, spec)),
            ("kept", stream_context(arriving, spec).select("doc_id", "idx", "line", "hit", "starts"),
             line_rows.context_lines(rest, spec).select("doc_id", "idx", "line", "hit", "starts")),
        ):
            target = str(tmp_path / f"{name}{at}")
            grep.run_to_parquet(run, target, target + "-check")
            got = spark.read.schema(run.schema).parquet(target)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_arriving_lines_are_written_by_as_many_tasks_as_read_the_documents(spark, tmp_path, monkeypatch):
    import glob

    from marginalia.catalog import outputs

    rows = [(n, "\n".join(f"ing {n} {k}" for k in range(6)), "en", "src1", 1) for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(outputs, "work_folder", lambda spark, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(outputs, "search_lines", lambda lines, spec: lines.selectExpr("doc_id", "idx", "0 AS piece", "line AS out"))
    found = outputs.stream_lines(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["idx"]) for r in found) == [(n, k) for n in range(8) for k in range(6)]
    assert len(glob.glob(str(tmp_path / "stream-lines" / "in" / "*.parquet"))) > 3
    assert len(glob.glob(str(tmp_path / "stream-lines" / "checkpoint" / "commits" / "[0-9]*"))) == 3


def test_arriving_sources_share_states(spark, tmp_path):
    from marginalia.streaming import grep
    from marginalia.streaming.lines import stream_lines

    many = 6000
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for turn in (1, 0):
        spark.range(many).selectExpr("id AS doc_id", f"{turn}L AS idx", f"concat('hit ', id, ' {turn}') AS line").write.mode("append").parquet(folder)
    run = stream_lines(grep.read_documents(spark, folder, spark.read.parquet(folder).schema), LineSpec(("hit",), (), 1, 0))
    writer = run.writeStream.format("parquet").option("checkpointLocation", target + "-check").trigger(availableNow=True)
    stream = writer.start(target)
    stream.awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 2 * many and got.filter("out <> concat('hit ', doc_id, ' ', idx)").isEmpty()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress) < many


@pytest.mark.parametrize("kind", ["long", "string", "binary", "date", "decimal(20,2)", "boolean"])
def test_arriving_lines_of_sources_with_any_key(spark, tmp_path, kind):
    from marginalia.operators import line_rows
    from marginalia.streaming import grep
    from marginalia.streaming.lines import stream_lines

    keys = {
        "long": [None, 1 << 60, (1 << 60) + 1], "string": [None, "", "None"], "binary": [None, "é", "b"], "boolean": [None, "true", "false"],
        "date": [None, "2024-01-01", "0001-01-01"], "decimal(20,2)": [None, "123456789012345678.25", "0.10"],
    }[kind]
    lines = [(k if k is None else str(k), i, t) for k in keys for i, t in enumerate(["a", "hit", "", "b", "c", "gone hit", "hit"])]
    rest = spark.createDataFrame(lines, "doc_id string, idx long, line string").withColumn("doc_id", F.col("doc_id").cast(kind))
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for turn in (2, 0, 1):
        rest.filter(f"idx % 3 = {turn}").coalesce(1).write.mode("append").parquet(folder)
    spec = LineSpec(("hit",), ("gone",), 1, 1, True)
    run = stream_lines(grep.read_documents(spark, folder, rest.schema, files_per_batch=1), spec)
    before = spark.conf.get(grep.VERSIONS_CONF)
    grep.run_to_parquet(run, target, target + "-check", versions=0)
    assert spark.conf.get(grep.VERSIONS_CONF) == before != "0"
    got, want = spark.read.schema(run.schema).parquet(target), line_rows.grep_rows(rest, spec)
    assert run.schema["doc_id"].dataType == rest.schema["doc_id"].dataType
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.count() == 18
