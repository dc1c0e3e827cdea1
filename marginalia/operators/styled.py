"""Structured text tables to markdown rows.

Results stay one row per paragraph, table line, slide or page, in a stated order; a whole document is never
gathered into one value. ``operators.sinks.save_combined`` writes such rows out in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.markdown import cell_text, markdown_link, table_line, table_rule
from ..functions.styled import (
    document_paragraph, has_mark, has_odd_blanks, marked_runs, marked_text, page_text, run_state, slide_text,
)
from .joins import join_keys
from .numbering import numbered


def ordered_array(order: Sequence[str], value: Column) -> Column:
    """Values of a group in order. Groups here are one paragraph, cell, table row, slide or page."""
    sorted_structs = F.sort_array(F.collect_list(F.struct(*order, value.alias("__value"))))
    return F.transform(sorted_structs, lambda s: s["__value"])


def with_links(runs: DataFrame, links: DataFrame) -> DataFrame:
    """Look up link targets; an unknown link id leaves ``uri`` null.

    Of a link id that a document gives more than once the first counts (see ``first_defined``), so runs never multiply.
    Only runs with a link id meet the links; all others pass by without a shuffle.
    """
    targets = first_defined(links.filter(F.col("link_id").isNotNull()), ["doc_id", "link_id"], "uri")
    linked = runs.filter(F.col("link_id").isNotNull()).join(targets, ["doc_id", "link_id"], "left")
    others = runs.filter(F.col("link_id").isNull()).withColumn("uri", F.lit(None).cast(links.schema["uri"].dataType))
    return linked.unionByName(others)


def first_defined(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key with its first value: by the column ``ord`` if there is one, else the smallest."""
    order = "ord" if "ord" in rows.columns else value
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def list_kind(
    paragraphs: DataFrame, numbering: DataFrame, abstract_numbering: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Resolve numbering ids to ``bullet``, ``numbered`` or ``none`` through the level 0 format.

    ``keys`` names the columns that tell documents apart when each has its own definitions. Of repeated
    definitions the first counts (see ``first_defined``), so paragraphs never multiply. Paragraphs without a
    numbering id take no part in the join.
    """
    level0 = first_defined(abstract_numbering.filter(F.col("level") == 0), [*keys, "abstract_id"], "fmt")
    numbers = first_defined(numbering.filter(F.col("num_id").isNotNull()), [*keys, "num_id"], "abstract_id")
    formats = numbers.join(level0, [*keys, "abstract_id"], "left").select(*keys, "num_id", "fmt")
    numbered_ones = paragraphs.filter(F.col("num_id").isNotNull()).join(formats, [*keys, "num_id"], "left")
    others = paragraphs.filter(F.col("num_id").isNull()).withColumn("fmt", F.lit(None).cast("string"))
    joined = numbered_ones.unionByName(others)
    kind = (
        F.when(F.col("num_id").isNull(), "none").when(F.col("fmt") == "bullet", "bullet").otherwise("numbered")
    )
    return joined.withColumn("list_kind", kind).drop("fmt")


def styled_paragraphs(runs: DataFrame) -> DataFrame:
    """Run rows ``(doc_id, para, k, style, list_kind, kind, bold, italic, text, uri)`` to paragraph rows.

    Runs are gathered per paragraph where they are read, so the one shuffle moves paragraphs, not runs. A paragraph
    without bold or italic is its texts in order; marks are worked out only for the others, in one pass where all are
    runs in a settled order between plain spaces. Elements with the same ``k`` come in the order of their marks and texts.
    """
    is_run = (F.col("kind") == "run") & (F.col("text") != "")
    link = F.when(F.col("kind") == "link", markdown_link(F.col("text"), F.col("uri"))).otherwise("")
    rows = runs.withColumn("__run", is_run).withColumn("__text", F.when(is_run, F.col("text")).otherwise(link))
    rows = rows.withColumn("__state", F.when(F.col("__run"), run_state(F.col("bold"), F.col("italic"))))
    element = F.struct("k", F.col("__text").alias("text"), F.col("__state").alias("state"))
    rows = rows.select("doc_id", "para", "k", "style", "list_kind", "__text", "__state")  # flat rows are smaller to sort
    odd = F.col("__state").isNull() | F.col("k").isNull() | has_odd_blanks(F.col("__text"))
    paragraphs = rows.groupBy("doc_id", "para").agg(
        F.min(F.struct("k", "style", "list_kind")).alias("__first"),
        F.bool_or(has_mark(F.col("__state"))).alias("__marked"),
        F.bool_or((F.col("__text") != "") & odd).alias("__odd"),
        F.sort_array(F.collect_list(F.when(F.col("__text") != "", element))).alias("__elements"),
    )
    elements = F.col("__elements")
    repeated = F.size(F.array_distinct(elements["k"])) < F.size(elements)
    plain = F.array_join(elements["text"], "")
    marked = F.when(F.col("__odd") | repeated, marked_text(elements)).otherwise(marked_runs(elements))
    text = F.when(F.col("__marked") | repeated, marked).otherwise(plain)
    out = document_paragraph(text, F.col("__first.style"), F.col("__first.list_kind"))
    return paragraphs.select("doc_id", "para", out.alias("out"))


def table_rows(cells: DataFrame, table: Sequence[str] = ("doc_id", "tbl")) -> DataFrame:
    """Cell paragraph rows ``(table, row, col, para, text)`` to one array of cell texts per table row.

    Both groupings run on one shuffle by table row.
    """
    together = cells.repartition(*table, "row")
    by_cell = together.groupBy(*table, "row", "col").agg(
        cell_text(ordered_array(["para"], F.col("text"))).alias("cell")
    )
    return by_cell.groupBy(*table, "row").agg(ordered_array(["col"], F.col("cell")).alias("cells"))


def markdown_table(rows: DataFrame, table: Sequence[str]) -> DataFrame:
    """Rows ``(table, row, cells)`` to lines ``(table, row, part, line)``: the first row, a rule, the rest.

    The first row of each table comes from an aggregate; table lines stay rows.
    """
    first = rows.groupBy(*table).agg(F.min("row").alias("row")).withColumn("__first", F.lit(True))
    marked = join_keys(rows, first, [*table, "row"], "left")
    line, rule = table_line(F.col("cells")), table_rule(F.col("cells"))
    lines = F.when(F.col("__first"), F.array(line, rule)).otherwise(F.array(line))
    return marked.select(*table, "row", F.posexplode(lines).alias("part", "line"))


def slide_sections(shapes: DataFrame, slice_slides: int = 4096) -> DataFrame:
    """Shape rows ``(doc_id, slide, ord, kind, text)`` to one row per slide, numbered from 1 in slide order."""
    kind = F.col("kind")
    only = lambda wanted: F.transform(
        F.filter("shapes", lambda s: s["kind"] == wanted), lambda s: s["text"]
    )
    slides = shapes.groupBy("doc_id", "slide").agg(
        ordered_array(["ord"], F.struct(kind, F.col("text"))).alias("shapes")
    )
    slides = numbered(
        slides.select(
            "doc_id", "slide", F.get(only("title"), 0).alias("title"), only("text").alias("texts"),
            only("table").alias("tables"),
        ),
        ["doc_id"], [F.col("slide")], F.expr(f"slide div {slice_slides}"), "number",
    )
    out = slide_text(F.col("number"), F.col("title"), F.col("texts"), F.col("tables"))
    return slides.select("doc_id", "slide", "number", out.alias("out"))


def page_sections(blocks: DataFrame) -> DataFrame:
    """Block rows ``(doc_id, page_no, block_no, text)`` to one row per page."""
    pages = blocks.groupBy("doc_id", "page_no").agg(
        ordered_array(["block_no"], F.col("text")).alias("blocks")
    )
    return pages.select("doc_id", "page_no", page_text(F.col("page_no"), F.col("blocks")).alias("out"))
