"""Registered queries: structured text to markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import styled as styles
from ..operators import styled
from . import inputs
from .registry import query


def _runs(spark, sf_dir):
    """Words as runs: bold, italic, leading blanks, empty runs and paragraph styles by position."""
    k, para = F.col("k"), F.col("para")
    text = (
        F.when(F.col("word") == "", F.lit(""))
        .when(k % 5 == 0, F.concat(F.lit(" "), "word", F.lit("  ")))
        .otherwise(F.concat("word", F.lit(" ")))
    )
    return inputs.words(spark, sf_dir).select(
        "doc_id",
        "para",
        "k",
        F.when(para % 3 == 0, F.concat(F.lit("Heading"), (para % 9).cast("string"))).otherwise("Normal").alias("style"),
        F.when(para % 4 == 1, "bullet").when(para % 4 == 2, "numbered").otherwise("none").alias("list_kind"),
        F.lit("run").alias("kind"),
        (k % 3 == 0).alias("bold"),
        (k % 4 < 2).alias("italic"),
        text.alias("text"),
    )


_PREFIX = """CASE WHEN para % 3 = 0 AND para % 9 > 0 THEN repeat('#', least(para % 9, 6)::INT) || ' ' ELSE '' END
  || CASE para % 4 WHEN 1 THEN '- ' WHEN 2 THEN '1. ' ELSE '' END"""
_RUN_TEXT = "CASE WHEN k % 5 = 0 THEN ' ' || word || '  ' ELSE word || ' ' END"
_STYLED = f"""{inputs.VWORDS},
runs AS (SELECT doc_id, para, k, k % 3 = 0 AS bold, k % 4 < 2 AS italic, {_RUN_TEXT} AS text FROM vwords WHERE word <> ''),
near AS (
  SELECT *, coalesce(lag(bold) OVER w, false) AS was_bold, coalesce(lag(italic) OVER w, false) AS was_italic,
         coalesce(lead(bold) OVER w, false) AS next_bold, coalesce(lead(italic) OVER w, false) AS next_italic
  FROM runs WINDOW w AS (PARTITION BY doc_id, para ORDER BY k)),
pieces AS (
  SELECT doc_id, para, k,
         left(text, length(text) - length(ltrim(text)))
         || CASE WHEN bold AND NOT was_bold THEN '**' ELSE '' END || CASE WHEN italic AND NOT was_italic THEN '_' ELSE '' END
         || trim(text)
         || CASE WHEN italic AND NOT next_italic THEN '_' ELSE '' END || CASE WHEN bold AND NOT next_bold THEN '**' ELSE '' END
         || right(text, length(text) - length(rtrim(text))) AS piece
  FROM near),
bodies AS (SELECT doc_id, para, string_agg(piece, '' ORDER BY k) AS body FROM pieces GROUP BY 1, 2),
paras AS (SELECT DISTINCT doc_id, para FROM vwords)"""


@query(
    f"""WITH {_STYLED}
SELECT doc_id, para, {_PREFIX} || coalesce(body, '') || CASE WHEN para % 4 IN (1, 2) THEN '' ELSE chr(10) END AS out
FROM paras LEFT JOIN bodies USING (doc_id, para)"""
)
def styled_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("uri", F.lit(None).cast("string"))
    return styled.styled_paragraphs(runs)


@query(f"WITH {inputs.VLINES} SELECT doc_id, idx AS para, {_PREFIX} || line AS out FROM (SELECT *, idx AS para FROM vlines)")
def paragraph_prefix(spark, sf_dir):
    para = F.col("idx")
    style = F.when(para % 3 == 0, F.concat(F.lit("heading"), (para % 9).cast("string"))).otherwise("Title")
    kind = F.when(para % 4 == 1, "bullet").when(para % 4 == 2, "numbered").otherwise("none")
    out = F.concat(styles.paragraph_prefix(style, kind), "line")
    return inputs.lines(spark, sf_dir).select("doc_id", para.alias("para"), out.alias("out"))


@query(
    f"""WITH {inputs.VLINES},
asked AS (SELECT doc_id, idx AS para, CASE WHEN idx % 3 <> 0 THEN idx % 30 END AS num_id FROM vlines)
SELECT doc_id, para, CASE WHEN num_id IS NULL THEN 'none' WHEN r_regionkey % 2 = 0 THEN 'bullet' ELSE 'numbered' END AS list_kind
FROM asked LEFT JOIN nation ON num_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def list_kind(spark, sf_dir):
    numbering = inputs.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("num_id"), F.col("n_regionkey").alias("abstract_id")
    )
    levels = inputs.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("abstract_id"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("level"),
        F.when(F.col("r_regionkey") % 2 == 0, "bullet").otherwise("decimal").alias("fmt"),
    )
    idx = F.col("idx")
    paragraphs = inputs.lines(spark, sf_dir).select(
        "doc_id", idx.alias("para"), F.when(idx % 3 != 0, (idx % 30).cast("int")).alias("num_id")
    )
    return styled.list_kind(paragraphs, numbering, levels).select("doc_id", "para", "list_kind")


@query(
    f"""WITH {inputs.VWORDS},
links AS (SELECT page_id AS doc_id, 'rId' || (page_id % 4) AS link_id, url AS uri FROM pages),
elements AS (SELECT doc_id, para, k, word, CASE WHEN k % 6 = 5 THEN 'rId' || (k % 4) END AS link_id FROM vwords),
shown AS (
  SELECT e.*, CASE WHEN link_id IS NULL THEN word || ' ' ELSE coalesce('[' || word || '](' || uri || ')', '') END AS piece
  FROM (SELECT e.*, uri FROM elements e LEFT JOIN links l ON e.doc_id = l.doc_id AND e.link_id = l.link_id) e
  WHERE word <> '' OR link_id IS NOT NULL)
SELECT doc_id, para, coalesce(out, '') AS out FROM (SELECT DISTINCT doc_id, para FROM vwords)
LEFT JOIN (SELECT doc_id, para, string_agg(piece, '' ORDER BY k) AS out FROM shown GROUP BY 1, 2) USING (doc_id, para)"""
)
def markdown_links(spark, sf_dir):
    links = inputs.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.concat(F.lit("rId"), (F.col("page_id") % 4).cast("string")).alias("link_id"),
        F.col("url").alias("uri"),
    )
    linked = F.col("k") % 6 == 5
    text = F.when(linked | (F.col("word") == ""), F.col("word")).otherwise(F.concat("word", F.lit(" ")))
    runs = inputs.words(spark, sf_dir).select(
        "doc_id",
        "para",
        "k",
        F.lit("Normal").alias("style"),
        F.lit("bullet").alias("list_kind"),
        F.when(linked, "link").otherwise("run").alias("kind"),
        F.lit(False).alias("bold"),
        F.lit(False).alias("italic"),
        F.when(linked, F.concat(F.lit("rId"), (F.col("k") % 4).cast("string"))).alias("link_id"),
        text.alias("text"),
    )
    paragraphs = styled.styled_paragraphs(styled.with_links(runs, links))
    return paragraphs.withColumn("out", F.substring("out", 3, 2147483647))


@query(
    """WITH links AS (SELECT page_id AS doc_id, page_id % 3 AS link_id, i AS ord, CASE i WHEN 1 THEN url WHEN 2 THEN 'a/' || url ELSE url || '/0' END AS uri
  FROM pages, (VALUES (1), (2), (3)) v(i) WHERE i < 3 OR page_id % 2 = 0)
SELECT doc_id, k, uri FROM (SELECT doc_id, unnest(generate_series(0, 3)) AS k FROM documents) r
LEFT JOIN (SELECT doc_id, link_id, min_by(uri, ord) AS uri FROM links GROUP BY 1, 2) l USING (doc_id) WHERE k = link_id
UNION ALL SELECT doc_id, k, NULL FROM (SELECT doc_id, unnest(generate_series(0, 3)) AS k FROM documents) WHERE k <> doc_id % 3 OR doc_id NOT IN (SELECT page_id FROM pages)"""
)
def repeated_links(spark, sf_dir):
    """Runs whose link id is given two or three times: the first target counts and no run is doubled."""
    times = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ord")
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", "url", times).filter("ord < 3 OR page_id % 2 = 0")
    uri = F.when(F.col("ord") == 1, F.col("url")).when(F.col("ord") == 2, F.concat(F.lit("a/"), "url")).otherwise(F.concat("url", F.lit("/0")))
    links = pages.select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 3).alias("link_id"), "ord", uri.alias("uri"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k")
    runs = inputs.table(spark, sf_dir, "documents").select("doc_id", k).withColumn("link_id", F.col("k"))
    return styled.with_links(runs, links).select("doc_id", "k", "uri")


@query(
    f"""WITH {inputs.VWORDS}, shown AS (
  SELECT doc_id, para, string_agg(CASE WHEN k > 0 AND (k - 1) % 4 = 3 THEN '<br/>' ELSE '' END
    || CASE WHEN word = '' THEN '' ELSE word || ' ' END, '' ORDER BY k) AS text FROM vwords GROUP BY 1, 2)
SELECT doc_id, para, CASE WHEN rtrim(text) <> '' THEN '- ' || rtrim(text) ELSE '' END AS out FROM shown"""
)
def soft_breaks(spark, sf_dir):
    """Paragraphs built inside their row: a word is a run, every fourth word has a break after it."""
    run = lambda w: F.struct(
        F.lit("run").alias("kind"), F.lit(False).alias("bold"), F.lit(False).alias("italic"),
        F.when(w == "", "").otherwise(F.concat(w, F.lit(" "))).alias("text"),
        F.lit(None).cast("string").alias("uri"), F.lit(False).alias("linked"),
    )
    broken = F.struct(
        F.lit("break").alias("kind"), F.lit(False).alias("bold"), F.lit(False).alias("italic"),
        F.lit("").alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(False).alias("linked"),
    )
    elements = F.flatten(
        F.transform(
            F.split("line", " ", -1),
            lambda w, i: F.when(i % 4 == 3, F.array(run(w), broken)).otherwise(F.array(run(w))),
        )
    )
    rows = inputs.lines(spark, sf_dir).select("doc_id", F.col("idx").alias("para"), elements.alias("elements"))
    out = styles.slide_paragraph(F.col("elements"), F.lit("bullet"), "<br/>")
    return rows.select("doc_id", "para", out.alias("out"))


@query(
    f"""WITH {inputs.VLINES},
paras AS (SELECT doc_id, idx // 12 AS tbl, (idx % 12) // 4 AS row, (idx % 4) // 2 AS col, idx % 2 AS para,
    rtrim(line) || CASE WHEN idx % 5 = 0 THEN ' ' ELSE '' END AS text FROM vlines),
cells AS (SELECT doc_id, tbl, row, col, coalesce(string_agg(rtrim(text), '<br/>' ORDER BY para) FILTER (trim(text) <> ''), '') AS cell
  FROM paras GROUP BY ALL)
SELECT doc_id, tbl, row, '| ' || string_agg(trim(cell), ' | ' ORDER BY col) || ' |' AS line FROM cells GROUP BY ALL"""
)
def cell_text(spark, sf_dir):
    from ..functions.markdown import table_line

    idx = F.col("idx")
    tail = F.when(idx % 5 == 0, " ").otherwise("")
    cells = inputs.lines(spark, sf_dir).select(
        "doc_id",
        F.expr("idx div 12").alias("tbl"),
        F.expr("(idx % 12) div 4").alias("row"),
        F.expr("(idx % 4) div 2").alias("col"),
        (idx % 2).alias("para"),
        F.concat(F.rtrim("line"), tail).alias("text"),
    )
    return styled.table_rows(cells).select("doc_id", "tbl", "row", table_line(F.col("cells")).alias("line"))


@query(
    """WITH firsts AS (SELECT c_nationkey AS tbl, min(c_custkey) AS first FROM customer GROUP BY 1)
SELECT c_nationkey AS tbl, c_custkey AS row, 0 AS part, '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' AS line FROM customer
UNION ALL SELECT tbl, first, 1, '|---|---|---|' FROM firsts"""
)
def markdown_table(spark, sf_dir):
    cells = F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    rows = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("tbl"), F.col("c_custkey").alias("row"), cells.alias("cells")
    )
    return styled.markdown_table(rows, ["tbl"])


@query(
    f"""WITH {inputs.VLINES},
shapes AS (SELECT doc_id, (idx // 4) * 10 AS slide, idx % 4 AS ord,
    CASE WHEN idx % 4 = 0 AND (idx // 4) % 3 <> 2 THEN 'title' WHEN idx % 4 = 3 THEN 'table' ELSE 'text' END AS kind, line AS text FROM vlines),
slides AS (SELECT doc_id, slide, row_number() OVER (PARTITION BY doc_id ORDER BY slide)::BIGINT AS number,
    max(text) FILTER (kind = 'title') AS title,
    string_agg(text || chr(10), '' ORDER BY ord) FILTER (kind = 'text' AND trim(text) <> '') AS texts,
    string_agg(chr(10) || text || chr(10) || chr(10), '' ORDER BY ord) FILTER (kind = 'table' AND trim(text) <> '') AS tables
  FROM shapes GROUP BY doc_id, slide)
SELECT doc_id, slide, number, '# Slide #' || number || coalesce(': ' || title, '') || chr(10) || chr(10)
  || coalesce(texts, '') || coalesce(tables, '') AS out FROM slides"""
)
def slide_sections(spark, sf_dir):
    idx = F.col("idx")
    kind = F.when((idx % 4 == 0) & (F.expr("idx div 4") % 3 != 2), "title").when(idx % 4 == 3, "table").otherwise("text")
    shapes = inputs.lines(spark, sf_dir).select(
        "doc_id", (F.expr("idx div 4") * 10).alias("slide"), (idx % 4).alias("ord"), kind.alias("kind"),
        F.col("line").alias("text"),
    )
    return styled.slide_sections(shapes)


@query(
    f"""WITH {inputs.VLINES}
SELECT doc_id, idx // 10 + 1 AS page_no, '## Page ' || (idx // 10 + 1) || chr(10) || chr(10)
  || string_agg(line || chr(10) || chr(10), '' ORDER BY idx) || chr(10) AS out FROM vlines GROUP BY doc_id, idx // 10"""
)
def page_sections(spark, sf_dir):
    blocks = inputs.lines(spark, sf_dir).select(
        "doc_id", (F.expr("idx div 10") + 1).alias("page_no"), (F.col("idx") % 10).alias("block_no"),
        F.col("line").alias("text"),
    )
    return styled.page_sections(blocks)
