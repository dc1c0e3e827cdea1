import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from marginalia.catalog import inputs
from marginalia.functions import markdown, paths
from marginalia.operators import sinks
from marginalia.operators.report import combined_output
from marginalia.operators.select import select_files
from marginalia.plans.find_files import find_files
from marginalia.sources import files as sources
from marginalia.spec import FileSpec, LineSpec


def read_or_error(spark, root, listed=None, **options):
    files = sources.list_files(spark, root) if listed is None else listed
    rows = sources.decoded(sources.read_content(spark, files, root, **options)).collect()
    return {r["path"]: (r["text"], r["error"]) for r in rows}


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    root = tmp_path / "odd names é %20"
    root.mkdir()
    for name in ("good.md", "gone.md", "turned.md", "a b%41 ü.md"):
        (root / name).write_text(f"text of {name}")
    with open(root / "huge.md", "wb") as file:  # takes no room on disk
        file.truncate(3 << 30)
    files = spark.createDataFrame(sources.list_files(spark, str(root)).collect())
    (root / "gone.md").unlink()
    (root / "turned.md").unlink()
    (root / "turned.md").mkdir()
    got = read_or_error(spark, str(root), files)
    assert got["good.md"] == ("text of good.md", None) and got["a b%41 ü.md"] == ("text of a b%41 ü.md", None)
    assert got["huge.md"] == (None, f"{3 << 30} bytes are more than the {512 << 20} that are read")
    for name in ("gone.md", "turned.md"):
        assert got[name][0] is None and got[name][1]
    (root / "good.md").write_text("x" * 50)  # grew since it was listed
    assert read_or_error(spark, str(root), files, max_bytes=20)["good.md"] == (None, "it grew beyond the 20 bytes that are read")


def test_a_forbidden_file_is_a_row_with_its_reason(spark, tree, monkeypatch):
    from pyarrow import fs

    real = fs.LocalFileSystem()

    class Refusing:
        def open_input_stream(self, path, **options):
            if path.endswith("b.txt"):
                raise PermissionError(f"Permission denied: {path}")
            return real.open_input_stream(path, **options)

    class Uris:
        @staticmethod
        def from_uri(root):
            return Refusing(), root.removeprefix("file://")

    monkeypatch.setattr(fs, "FileSystem", Uris)
    import pyarrow as pa

    read = sources._reader(f"file://{tree}", 1000)
    batch = pa.RecordBatch.from_pydict({"path": ["a.md", "sub/b.txt", "sub/c.bin"], "length": [18, 14, 3]})
    rows = [row for out in read([batch]) for row in out.to_pylist()]
    assert [r["content"] is None for r in rows] == [False, True, False]
    assert rows[1]["error"].startswith("Permission denied") and rows[0]["error"] is None


def test_reading_is_dealt_by_bytes(spark, tmp_path):
    root = tmp_path / "many"
    root.mkdir()
    for i in range(40):
        (root / f"{i:02d}.txt").write_text("y" * (60_000 if i == 7 else 1000))
    read = sources.read_content(spark, sources.list_files(spark, str(root)), str(root), task_bytes=30_000)
    assert read.rdd.getNumPartitions() >= 7
    sizes = [sum(r["length"] for r in part) for part in read.select("length").rdd.glom().collect()]
    assert sum(sizes) == 39_000 + 60_000 and sorted(sizes)[-2] <= 12_000
    assert sources.read_files(spark, str(root), ["no/such"]).count() == 0


def test_unreadable_files_fail_content_tests_and_show_errors(spark, tree):
    from marginalia.plans.find_files import find_files_below

    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    shown = lambda read, **spec: {r["path"]: r["out"] for r in find_files_below(spark, tree, FileSpec(**spec), now, read).collect()}
    blocks = shown({"max_bytes": 15}, globs=("**/*.md", "**/*.txt"))
    assert blocks["a.md"] == "## a.md - Error reading file: 18 bytes are more than the 15 that are read\n\n"
    assert "second" in blocks["sub/b.txt"]
    assert set(shown({"max_bytes": 15}, globs=("**/*.md", "**/*.txt"), not_contains=("nothing",))) == {"sub/b.txt"}
    assert set(shown(None, globs=("**/*.md",), contains=("Title",))) == {"a.md"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_bytes(b"\xef\xbb\xbf# Title\n```` x\n")
    (root / "sub" / "b.txt").write_bytes(b"caf\xe9 \xc3\xa9\nsecond")
    (root / "sub" / "c.bin").write_bytes(b"a\x00b")
    (root / "sub" / "d.docx").write_bytes(b"PK\x00zip")
    return str(root)


def test_scan_and_decode(spark, tree):
    got = {r["path"]: r for r in sources.read_files(spark, tree).collect()}
    assert sorted(got) == ["a.md", "sub/b.txt", "sub/c.bin", "sub/d.docx"]
    assert got["a.md"]["text"] == "# Title\n```` x\n"
    assert got["sub/b.txt"]["text"] == "caf� é\nsecond"
    assert got["sub/c.bin"]["is_binary"] and got["sub/c.bin"]["text"] is None
    assert got["a.md"]["length"] == 18
    names = sources.scan_files(spark, tree, ["**/*.txt"]).select("path")
    assert [r["path"] for r in names.collect()] == ["sub/b.txt"]


def test_names_only_plan_leaves_content_unread(spark, tree, capsys):
    sources.list_files(spark, tree).filter("length > 5").select("path").explain()
    plan = capsys.readouterr().out
    assert "content" not in plan.split("ReadSchema")[1] and "GreaterThan(length,5)" in plan


def test_find_files_with_converters(spark, tree):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    convert = {".docx": lambda path, content: f"from {path} {len(content)}"}
    rows = find_files(sources.read_files(spark, tree), FileSpec(), now, converters=convert).collect()
    out = {r["path"]: r["out"] for r in rows}
    assert out["sub/c.bin"] == ""
    assert "```markdown\nfrom sub/d.docx 6\n```" in out["sub/d.docx"]
    assert out["a.md"].endswith("Size: 18 bytes\n\n`````markdown\n# Title\n```` x\n\n`````\n")
    def broken(path, content):
        raise ValueError("bad zip")

    failed = find_files(sources.read_files(spark, tree), FileSpec(), now, converters={".docx": broken}).collect()
    out = {r["path"]: r["out"] for r in failed}
    assert out["sub/d.docx"] == "## sub/d.docx - Error reading file: bad zip\n\n" and out["a.md"].startswith("## a.md\n")
    single = find_files(sources.read_files(spark, tree), FileSpec(globs=("**/*.docx",)), now, converters=convert)
    assert single.first()["out"] == "from sub/d.docx 6"
    numbered = FileSpec(globs=("**/*.docx",), lines=LineSpec(numbers=True))
    wrapped = find_files(sources.read_files(spark, tree), numbered, now, converters=convert).first()["out"]
    assert wrapped.endswith("```markdown\n1: from sub/d.docx 6\n```\n")


@pytest.mark.parametrize(
    "path, template, want",
    [
        ("a/b/c.tar.gz", "{filePath}/{fileBase}-output.md", "a/b/c.tar-output.md"),
        ("c", "{filepath}/{filebase}.{fileext}", "c."),
        ("/x/c.md", "{fileName}", "x/c.md"),
        ("c.md", "o-{timestamp}-{time}", "o-T-M"),
        ("c.md", "\\ {FILENAME}/", "{FILENAME}"),
    ],
)
def test_templates(spark, path, template, want):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(paths.template_path(F.col("p"), template, "T", "M")).first()[0] == want


@pytest.mark.parametrize(
    "name, want", [("a/.ignore", ("a", "", ".ignore")), ("a.b", ("", "a", ".b")), ("x/a.", ("x", "a", "")), ("/r", ("", "r", ""))]
)
def test_path_parts(spark, name, want):
    p = F.lit(name)
    row = spark.range(1).select(paths.directory(p), paths.file_base(p), paths.extension(p)).first()
    assert tuple(row) == want


@pytest.mark.parametrize(
    "path, base, want",
    [
        ("/Data/a/b", "/data/", "a/b"),
        ("/data/x/y", "/data/in/deep", "../../x/y"),
        ("/data/in/y", "/data/in/deep", "../y"),
        ("/else", "/data", "../else"),
        ("a/b", "/data", "a/b"),
        ("src/a", "SRC", "a"),
        ("srca/a", "src", "srca/a"),
    ],
)
def test_relative_path(spark, path, base, want):
    assert spark.range(1).select(paths.relative_path(F.lit(path), base)).first()[0] == want


def test_sizes_and_ages(spark):
    sizes = [0, 1023, 1024, 1048575, 1 << 20, (1 << 30) - 1, 5 << 30]
    frame = spark.createDataFrame([(s,) for s in sizes], "n long")
    got = [r[0] for r in frame.select(markdown.friendly_size(F.col("n"))).collect()]
    assert got == ["0 bytes", "1023 bytes", "1 KB", "1023 KB", "1 MB", "1023 MB", "5 GB"]
    ages = [-50, 59, 60, 119, 120, 3599, 3600, 7200, 86399, 86400, 172800, 604799, 604800]
    frame = spark.createDataFrame([(a,) for a in ages], "n long")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    got = [r[0] for r in frame.select(markdown.friendly_age(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("n")), now)).collect()]
    assert got == [
        "just now", "just now", "1 minute ago", "1 minute ago", "2 minutes ago", "59 minutes ago", "1 hour ago",
        "2 hours ago", "23 hours ago", "1 day ago", "2 days ago", "6 days ago", "11/07/2023 22:13:20",
    ]


def test_image_types(spark):
    rows = [("a.txt", b"\xff\xd8\xff\xe0"), ("a.PNG", b"none"), ("a.gif", b"BM"), ("a", b"BMxx"), ("a.md", b"none")]
    frame = spark.createDataFrame(rows, "p string, c binary")
    got = [r[0] for r in frame.select(sources.image_type(F.col("p"), F.col("c"))).collect()]
    assert got == ["image/jpg", "image/png", "image/gif", "image/bmp", None]


def test_saving_files(spark, tmp_path):
    items = spark.createDataFrame([("x/a.md", "one\n"), ("b.md", "é")], "path string, content string")
    root = str(tmp_path / "out")
    sinks.save_per_item(sinks.output_paths(items, "{filePath}/{fileBase}.out", "T", "M"), root, as_files=True)
    assert open(root + "/x/a.out").read() == "one\n" and open(root + "/b.out").read() == "é"
    assert sorted(os.path.relpath(p, root) for p in glob.glob(root + "/**/*.*", recursive=True)) == ["b.out", "x/a.out"]
    with pytest.raises(ValueError, match="share an output path"):
        sinks.save_per_item(sinks.output_paths(items, "same.md", "T", "M"), root)
    with pytest.raises(Exception, match="leaves the target folder"):
        sinks.save_per_item(items.withColumn("out_path", F.concat(F.lit("../"), "path")), root, as_files=True)


def test_combined_report_reads_in_order(spark, tmp_path):
    rows = [(i, f"item {i}\nmore") for i in range(500)]
    items = spark.createDataFrame(rows, "ord int, out string").repartition(6)
    want = "\n".join(out for _, out in rows) + "\n"
    target = str(tmp_path / "report")
    sinks.save_combined(items, target, ["ord"])
    assert "".join(open(p).read() for p in sorted(glob.glob(target + "/part-*"))) == want


@pytest.mark.parametrize("spell", ["{}", "{}/", "file:{}", "file://{}", "file://{}/", "{}/../tree", "relative"])
def test_roots_of_any_spelling(spark, tree, spell):
    root = os.path.relpath(tree) if spell == "relative" else spell.format(tree)
    rows = sources.scan_files(spark, root, ["sub/**"]).select("path").collect()
    assert sorted(r["path"] for r in rows) == ["sub/b.txt", "sub/c.bin", "sub/d.docx"]


def test_binary_files_take_content_tests(spark, tree):
    files = sources.read_files(spark, tree)
    chosen = lambda **spec: sorted(r["path"] for r in select_files(files, FileSpec(**spec)).collect())
    assert chosen(not_contains=("nothing here",)) == ["a.md", "sub/b.txt", "sub/c.bin", "sub/d.docx"]
    assert chosen(contains=("zip",)) == ["sub/d.docx"]
    assert chosen(contains=("b",), not_contains=("zip",)) == ["sub/c.bin"]


def test_pieces_are_bounded_by_bytes(spark):
    rows = [("r", i // 7, f"{i:03d} " + "x" * (3000 if i % 50 == 0 else 5)) for i in range(400)]
    items = spark.createDataFrame(rows, "report string, ord long, out string").repartition(5)
    pieces = combined_output(items, ["report"], part_bytes=1000, slice_items=20).orderBy("part", "piece").collect()
    assert "\n".join(p["text"] for p in pieces) == "\n".join(out for _, _, out in rows)
    assert len(pieces) > 10 and max(len(p["text"]) for p in pieces) < 1000 + 3010


def test_only_long_parts_are_summed_by_ranges(spark, monkeypatch):
    """Parts of fewer bytes than a piece are joined as they are; null keys, ordinals and texts, repeated rows and a part of just a piece's bytes."""
    from itertools import groupby

    from marginalia.operators import report

    summed = []
    real = report.sum_before
    monkeypatch.setattr(report, "sum_before", lambda rows, *a, **b: summed.append(rows) or real(rows, *a, **b))
    rows = [(key, i // 2, f"{i:02d}" + "x" * (i % 3)) for key in ("a", None) for i in range(60)]
    rows += [("long", 3, f"{i:03d}" + "y" * 20) for i in range(80)] + [("long", 25, "z"), ("long", None, "none"), ("long", None, None)]
    rows += [("just", 40, "w" * 49), ("just", 41, "w" * 49), ("just", 42, None), ("null", 0, None), ("null", 1, None), ("a", 5, "10x"), ("a", 5, "10x")]
    items = spark.createDataFrame([(*r, "unused") for r in rows], "report string, ord long, out string, more string").repartition(3)
    got = report.combined_output(items, ["report"], part_bytes=100, slice_items=20)

    low = lambda v: (v is not None, v or (0 if isinstance(v, int) else ""))  # noqa: E731  nulls come first
    want = {}
    for part, own in groupby(sorted(((r[0], None if r[1] is None else r[1] // 20, *r[1:]) for r in rows), key=lambda r: (str(r[0]), *map(low, r[1:]))), lambda r: r[:2]):
        before = 0
        for *_, out in own:
            want.setdefault((*part, before // 100), []).append(out)
            before += 0 if out is None else len(out) + 1
    joined = {k: "\n".join(x for x in v if x is not None) for k, v in want.items()}
    assert {(r["report"], r["part"], r["piece"]): r["text"] for r in got.collect()} == joined and got.count() == len(joined)
    assert ("just", 2, 1) in joined and ("long", 0, 18) in joined
    assert {(r["report"], r["part"]) for r in summed[0].collect()} == {("long", 0), ("just", 2), ("a", 0), (None, 0)}
    assert "more" not in summed[0].columns


def test_history(spark, tmp_path):
    messages = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    target = sinks.save_history(messages, str(tmp_path), "123")
    assert target.endswith("chat-history-123.jsonl")
    lines = [json.loads(x) for p in sorted(glob.glob(target + "/part-*")) for x in open(p)]
    assert [(m["role"], m["content"]) for m in lines] == [("user", "a"), ("assistant", "b")]


def test_stream_reads_new_files_once(spark, tmp_path, sf_dir):
    from marginalia.streaming import grep

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = inputs.table(spark, sf_dir, "documents").withColumn("path", F.lit("x.txt"))
    spec = LineSpec(include=("ing ",), before=1)
    rows = lambda: grep.stream_grep(grep.read_documents(spark, folder, docs.schema), spec).select("doc_id", "report")
    docs.filter("doc_id < 50").write.mode("append").parquet(folder)
    grep.run_to_parquet(rows(), out, str(tmp_path / "check"))
    docs.filter("doc_id >= 50").write.mode("append").parquet(folder)
    grep.run_to_parquet(rows(), out, str(tmp_path / "check"))
    from marginalia.operators.lines import grep_report

    want = {(r["doc_id"], r["report"]) for r in grep_report(docs, spec).collect()}
    got = spark.read.parquet(out).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["report"]) for r in got} == want


def test_streamed_paths_are_settled_over_batches(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from marginalia.streaming import grep

    folder, schema = str(tmp_path / "in"), "path string, report string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    def save(name, on_repeat):
        rows = grep.read_documents(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
        grep.stream_save(rows, str(tmp_path / name), str(tmp_path / (name + "-check")), "{filePath}/{fileBase}.out", "S", "T", on_repeat=on_repeat)

    def saved(name):
        rows = spark.read.schema("out_path string, content string").parquet(str(tmp_path / name / "batch=*")).collect()
        return sorted((r["out_path"], r["content"]) for r in rows)

    arrive(("d/a.md", "1"), ("d/b.md", "1"))
    save("numbered", "number")
    save("strict", "error")
    arrive(("d/a.md", "2"))
    arrive(("d/a.md", "3"), ("d/c.md", "1"))
    save("numbered", "number")
    want = [("d/a (2).out", "2"), ("d/a (3).out", "3"), ("d/a.out", "1"), ("d/b.out", "1"), ("d/c.out", "1")]
    assert saved("numbered") == want
    with pytest.raises(StreamingQueryException, match="several items share an output path: d/a.out"):
        save("strict", "error")
    assert saved("strict") == [("d/a.out", "1"), ("d/b.out", "1")]
    # The last batch was written but its end was not recorded: it is replayed and replaces itself.
    ended = sorted(glob.glob(str(tmp_path / "numbered-check" / "commits" / "[0-9]*")), key=lambda p: int(os.path.basename(p)))
    os.remove(ended[-1])
    for crc in glob.glob(str(tmp_path / "numbered-check" / "commits" / ".*.crc")):
        os.remove(crc)
    save("numbered", "number")
    assert saved("numbered") == want
    arrive(("d/c.md", "x"), ("d/c.md", "x"))
    save("numbered", "number")
    assert [r for r in saved("numbered") if r[0].startswith("d/c")] == [("d/c (2).out", "x"), ("d/c (3).out", "x"), ("d/c.out", "1")]


def test_a_report_is_one_file(spark, tmp_path, monkeypatch):
    rows = [(i, f"item {i}\nmöre" if i % 7 else None) for i in range(3000)]
    items = spark.createDataFrame(rows, "ord int, out string").repartition(6)
    target = str(tmp_path / "out" / "report.md")
    want = "\n".join(out or "" for _, out in rows)
    for _ in range(2):  # a second run replaces the file
        sinks.save_report(items, target, ["ord"])
        assert open(target, encoding="utf-8").read() == want and os.listdir(tmp_path / "out") == ["report.md"]
    sinks.save_report(items.filter("ord = 1"), target, ["ord"])
    assert open(target, encoding="utf-8").read() == "item 1\nmöre"

    def fail(target):
        raise OSError("disk is full")

    monkeypatch.setattr(sinks, "_copy_parts", fail)
    with pytest.raises(OSError, match="disk is full"):
        sinks.save_report(items, target, ["ord"])
    assert open(target, encoding="utf-8").read() == "item 1\nmöre" and os.listdir(tmp_path / "out") == ["report.md"]
    sinks.save_report(items.limit(0), target, ["ord"])
    assert open(target).read() == ""


def test_each_command_is_saved_at_its_template(spark, tmp_path):
    from marginalia.plans.report import chained_report, save_commands

    frame = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "ord long, out string")
    pieces = chained_report([frame("a", "b"), frame("c"), frame("d")]).pieces
    files = save_commands(pieces, str(tmp_path), {0: "first/{fileBase}-{time}.{fileExt}", 2: "{fileName}"}, time="7")
    assert files == [str(tmp_path / "first" / "output-7.md"), str(tmp_path / "output.md")]
    assert [open(f).read() for f in files] == ["a\nb", "d"]
    with pytest.raises(ValueError, match="share an output path"):
        save_commands(pieces, str(tmp_path), {0: "x", 1: "x"})


def test_streamed_saving_takes_no_rows_to_python_and_numbers_as_splitext(spark, tmp_path):
    from pyspark.sql import functions as F

    from marginalia.streaming import grep

    paths = ["a/b.md", "a.d/b", "a/.b", "a/..b.c", "b.x.md", "a\nb/c.d", ".b", "x/", "a/b.", ""]
    rows = spark.createDataFrame([(p, n) for p in paths for n in (1, 3)], "p string, n int")
    got = rows.select("p", "n", grep.numbered_path(F.col("p"), F.col("n")).alias("out")).collect()
    split = lambda r: " (3)".join(os.path.splitext(r["p"])) if r["n"] > 1 else r["p"]
    assert [r["out"] for r in got] == [split(r) for r in got]
    arrived = spark.createDataFrame([(f"p{n % 3}.md", str(n), n) for n in range(3000)], "out_path string, content string, __row long")
    again = spark.createDataFrame([("p1.md", 7), ("p2.md", 0)], "out_path string, before long")
    settled = grep.settle_paths(arrived.filter("__row % 3 > 0 OR __row = 0"), again)
    assert "Python" not in settled._jdf.queryExecution().toString() and "Pandas" not in settled._jdf.queryExecution().toString()
    found = {r["content"]: r["out_path"] for r in settled.collect()}
    assert (found["0"], found["1"], found["2"], found["2998"], found["2999"]) == ("p0.md", "p1 (8).md", "p2.md", "p1 (1007).md", "p2 (1000).md")
    assert len(found) == len(set(found.values())) == 2001


def test_few_tasks_list_many_files(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"{n}.txt").write_text("x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")  # as with very many files: one file per partition
    try:
        listed = sources.list_files(spark, str(tmp_path))
        assert listed.count() == 40
        assert listed.rdd.getNumPartitions() <= sources.LISTING_TASKS * spark.sparkContext.defaultParallelism < 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
