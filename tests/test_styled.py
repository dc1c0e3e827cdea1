import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import styled as styles
from marginalia.functions.markdown import cell_text
from marginalia.operators import styled

MARK = {"bold": "**", "italic": "_"}


def sequence(elements, break_text=None):
    """Tokens of a paragraph: characters, and marks that sink left past white space when they close."""
    tokens, on, broken = [], {"bold": False, "italic": False}, False
    for kind, bold, italic, text, uri in elements:
        if kind == "break":
            broken = True
            continue
        if kind == "link":
            tokens += list(f"[{text}]({uri})" if uri is not None else "")
            continue
        if broken:
            tokens += list(break_text)
            broken = False
        if text == "":
            continue
        now = {"bold": bold, "italic": italic}
        tokens += [("close", MARK[m]) for m in ("italic", "bold") if on[m] and not now[m]]
        opens = [MARK[m] for m in ("bold", "italic") if now[m] and not on[m]]
        core = text.lstrip()
        lead = text[: len(text) - len(core)]
        shown = core if opens else text
        if break_text is not None and uri is not None:
            shown = f"[{shown}]({uri})"
        tokens += (list(lead) + ["".join(opens)] if opens else []) + list(shown)
        on = now
    tokens += [("close", MARK[m]) for m in ("italic", "bold") if on[m]]
    moved = True
    while moved:
        moved = False
        for i in range(1, len(tokens)):
            if isinstance(tokens[i], tuple) and isinstance(tokens[i - 1], str) and tokens[i - 1].isspace():
                tokens[i - 1], tokens[i] = tokens[i], tokens[i - 1]
                moved = True
    return "".join(t[1] if isinstance(t, tuple) else t for t in tokens)


TEXTS = ["a", "b ", " c", " ", "", "  d  ", " e ", "\t", "x y"]


def random_paragraph(rng, kinds):
    out = []
    for _ in range(rng.randint(0, 9)):
        kind = rng.choice(kinds)
        uri = rng.choice([None, "u"]) if kind == "link" else None
        out.append((kind, kind == "run" and rng.random() < 0.5, kind == "run" and rng.random() < 0.5, rng.choice(TEXTS), uri))
    return out


SCHEMA = "id long, e array<struct<kind: string, bold: boolean, italic: boolean, text: string, uri: string>>"


def test_random_document_paragraphs(spark):
    rng = random.Random(3)
    paragraphs = [random_paragraph(rng, ["run", "run", "run", "link"]) for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(paragraphs)), SCHEMA)
    got = {r["id"]: r["t"] for r in frame.select("id", styles.styled_text(F.col("e")).alias("t")).collect()}
    rows = frame.select(
        (F.col("id") % 50).alias("doc_id"), F.expr("id div 50").alias("para"), F.lit(None).cast("string").alias("style"),
        F.lit("bullet").alias("list_kind"), F.posexplode_outer("e").alias("k", "x"),
    ).select("doc_id", "para", "k", "style", "list_kind", "x.*").filter(F.col("kind").isNotNull()).repartition(5)
    tabled = {r["para"] * 50 + r["doc_id"]: r["out"] for r in styled.styled_paragraphs(rows).collect()}
    for i, paragraph in enumerate(paragraphs):
        want = sequence(paragraph)
        assert got[i] == want, paragraph
        if paragraph:
            assert tabled[i] == "- " + want, paragraph


def test_random_slide_paragraphs(spark):
    rng = random.Random(4)
    paragraphs = [random_paragraph(rng, ["run", "run", "break"]) for _ in range(400)]
    paragraphs += [[("run", True, False, "a", None), ("break", False, False, "", None), ("run", False, False, "b", None)]]
    frame = spark.createDataFrame(list(enumerate(paragraphs)), SCHEMA)
    elements = F.transform("e", lambda e: e.withField("linked", e["uri"].isNotNull()))
    for mark in ("\n", ": ", "<br/>"):
        out = styles.slide_paragraph(elements, F.lit("none"), mark)
        for r in frame.select("id", out.alias("t")).collect():
            assert r["t"] == sequence(paragraphs[r["id"]], mark).rstrip(), paragraphs[r["id"]]


def test_linked_run_keeps_its_marks(spark):
    element = "struct<kind: string, bold: boolean, italic: boolean, text: string, uri: string, linked: boolean>"
    rows = [([("run", True, False, " go ", "u", True), ("run", False, False, "on", None, False)],), ([("run", False, False, "lost", None, True)],)]
    frame = spark.createDataFrame(rows, f"e array<{element}>")
    got = [r[0] for r in frame.select(styles.slide_paragraph(F.col("e"), F.lit("numbered"))).collect()]
    assert got == ["1.  **[go ](u)**on", ""]


@pytest.mark.parametrize(
    "style, level",
    [("Heading1", 1), ("heading 6", 6), ("HEADING9", 6), ("Heading0", 0), ("Heading-1", 0), ("HeadingX", 0), ("Title", 0), (None, 0), ("Heading99999999999", 0)],
)
def test_heading_levels(spark, style, level):
    frame = spark.createDataFrame([(style,)], "s string")
    assert frame.select(styles.heading_level(F.col("s"))).first()[0] == level


def test_cells_and_tables(spark):
    cells = [(1, 0, 0, 1, 0, " b "), (1, 0, 0, 0, 0, "a"), (1, 0, 0, 0, 1, "  "), (1, 0, 0, 0, 2, "c "), (1, 0, 3, 0, 0, ""), (1, 0, 3, 1, 0, "z")]
    frame = spark.createDataFrame(cells, "doc_id long, tbl int, row int, col int, para int, text string")
    rows = styled.table_rows(frame)
    lines = styled.markdown_table(rows, ["doc_id", "tbl"]).orderBy("row", "part").collect()
    assert [r["line"] for r in lines] == ["| a<br/>c | b |", "|---|---|", "|  | z |"]
    assert spark.range(1).select(cell_text(F.array(F.lit("  ")))).first()[0] == ""


def test_slides_and_pages(spark):
    shapes = [(1, 7, 1, "text", "body"), (1, 7, 0, "title", "Top"), (1, 7, 2, "text", "  "), (1, 9, 0, "table", "| x |\n"), (2, 1, 0, "title", "")]
    frame = spark.createDataFrame(shapes, "doc_id long, slide long, ord int, kind string, text string")
    got = {(r["doc_id"], r["number"]): r["out"] for r in styled.slide_sections(frame, slice_slides=8).collect()}
    assert got == {
        (1, 1): "# Slide #1: Top\n\nbody\n",
        (1, 2): "# Slide #2\n\n\n| x |\n\n\n",
        (2, 1): "# Slide #1: \n\n",
    }
    blocks = spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 0, "a"), (1, 2, 0, "c")], "doc_id long, page_no int, block_no int, text string")
    pages = styled.page_sections(blocks).orderBy("page_no").collect()
    assert [r["out"] for r in pages] == ["## Page 1\n\na\n\nb\n\n\n", "## Page 2\n\nc\n\n\n"]


def test_list_kinds(spark):
    paragraphs = spark.createDataFrame([(0, None), (1, 1), (2, 2), (3, 9)], "p int, num_id int")
    numbering = spark.createDataFrame([(1, 10), (2, 20)], "num_id int, abstract_id int")
    levels = spark.createDataFrame([(10, 0, "bullet"), (10, 1, "decimal"), (20, 0, "lowerRoman")], "abstract_id int, level int, fmt string")
    got = {r["p"]: r["list_kind"] for r in styled.list_kind(paragraphs, numbering, levels).collect()}
    assert got == {0: "none", 1: "bullet", 2: "numbered", 3: "numbered"}


def test_list_kinds_per_document(spark):
    paragraphs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "doc_id string, num_id int")
    numbering = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "doc_id string, num_id int, abstract_id int")
    levels = spark.createDataFrame([("a", 10, 0, "decimal"), ("b", 10, 0, "bullet")], "doc_id string, abstract_id int, level int, fmt string")
    got = {r["doc_id"]: r["list_kind"] for r in styled.list_kind(paragraphs, numbering, levels, ["doc_id"]).collect()}
    assert got == {"a": "numbered", "b": "bullet", "c": "numbered"}


def test_repeated_definitions_do_not_multiply_paragraphs(spark):
    paragraphs = spark.createDataFrame([(1, 5), (2, None), (3, 6), (4, 9)], "para int, num_id int")
    numbering = spark.createDataFrame([(5, 1, 0), (5, 2, 1), (6, 2, 0), (None, 1, 0)], "num_id int, abstract_id int, ord int")
    levels = spark.createDataFrame([(1, 0, "bullet"), (1, 0, "bullet"), (2, 0, "decimal"), (2, 1, "bullet")], "abstract_id int, level int, fmt string")
    got = [(r["para"], r["list_kind"]) for r in styled.list_kind(paragraphs, numbering, levels).orderBy("para").collect()]
    assert got == [(1, "bullet"), (2, "none"), (3, "numbered"), (4, "numbered")]


RUNS = "doc_id long, para long, k long, style string, list_kind string, kind string, bold boolean, italic boolean, text string, uri string"


def test_paragraphs_are_shuffled_not_runs(spark):
    rows = [(1, p, k, "Title", "bullet", "run", False, False, "a ", None) for p in range(5) for k in range(400)]
    out = styled.styled_paragraphs(spark.createDataFrame(rows, RUNS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    assert plan.index("partial_collect_list") > plan.index("Exchange"), plan
    assert {r["para"]: r["out"] for r in out.collect()} == {p: "- " + "a " * 400 for p in range(5)}


def test_paragraphs_of_odd_runs(spark):
    run = lambda p, k, text, bold=False, italic=False, kind="run", uri=None, style="Title": (1, p, k, style, "none", kind, bold, italic, text, uri)
    rows = [
        run(0, 2, "b"), run(0, None, "a", style="Heading2"), run(0, 1, None), run(0, 3, "x", kind=None), run(0, 4, "", style=None),
        run(1, 1, "b "), run(1, 1, "b "), run(1, 1, "a "), run(1, 0, "c "),
        run(2, 0, "a ", True), run(2, 1, "b ", None, True), run(2, 2, "c ", None), run(2, 3, "d", True),
        run(3, 0, "go", kind="link", uri="u"), run(3, 1, "lost", kind="link"), run(3, 2, " ", True), run(3, 3, " x ", True, True),
        run(4, 0, "", True), run(4, None, "z", True),
    ]
    frame = spark.createDataFrame(rows, RUNS).repartition(3)
    got = {r["para"]: r["out"] for r in styled.styled_paragraphs(frame).collect()}
    assert got == {
        0: "## ab\n", 1: "c a b b \n", 2: "**a _b_ c **d**\n", 3: "[go](u) ** _x_** \n", 4: "**z\n",
    }


def test_runs_between_spaces_are_marked_in_one_pass(spark, monkeypatch):
    """All other paragraphs take the general way: blank runs, links, repeated or null places and other white space."""
    rng = random.Random(5)
    states = [(b, i) for b in (True, False, None) for i in (True, False, None)]
    text = lambda: " " * rng.randrange(3) + rng.choice(["a", "b c", "\u00e9", "x\ty", "\ufdd0", "_"]) + " " * rng.randrange(3)
    row = lambda p, k, t, state, kind="run", uri=None: (1, p, k, "Title", "none", kind, *state, t, uri)
    rows = [row(p, k, text(), rng.choice(states)) for p in range(300) for k in range(rng.randrange(1, 9))]
    odd = [("\ta", 1), ("a\xa0", 1), (" ", 1), ("\u3000 ", 1), ("a \n ", 1), ("a", 0), ("a", None), ("a", 2)]
    for p, (t, k) in enumerate(odd, 300):
        rows += [row(p, 0, "go ", (True, False)), row(p, k, t, (False, True), "link" if k == 2 else "run", "u")]
    rows += [row(307, 3, "on", (True, True)), row(308, None, "a", (True, True)), row(309, None, "b", (True, False)), row(309, None, "c", (False, True))]
    frame = spark.createDataFrame(rows, RUNS).repartition(3)
    outs = lambda: {r["para"]: r["out"] for r in styled.styled_paragraphs(frame).collect()}
    got = outs()
    monkeypatch.setattr(styled, "marked_text", lambda elements: F.lit("general"))
    general = {p for p, out in outs().items() if out == "general\n"}
    assert general == set(range(300, 310))
    monkeypatch.undo()
    monkeypatch.setattr(styled, "marked_runs", styled.marked_text)
    assert got == outs() and len(got) == 310
