"""Registered queries: files and their selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import line_hit
from ..operators import select, sinks
from ..plans.find_files import find_files_below
from ..session import work_folder
from ..sources import files as sources
from ..spec import FileSpec
from . import inputs
from .formatting import NOW
from .registry import query

GLOBS = ("**/en/*.md", "src1/**", "**/doc1*.t?t", "**.py")
IGNORE = ("src2/fr/", "doc[0-9]*7[.]", "", "**/*.HTML")
EXCLUDE = ("doc1*.md", "doc?.*", "src3/**/*.txt")

_GLOB_ORD = """CASE WHEN regexp_full_match(path, '(?i)([^/]*/)*en/[^/]*\\.md') THEN 0
  WHEN regexp_full_match(path, '(?i)src1/.*') THEN 1
  WHEN regexp_full_match(path, '(?i)([^/]*/)*doc1[^/]*\\.t[^/]t') THEN 2
  WHEN regexp_full_match(path, '(?i)([^/]*/)*[^/]*\\.py') THEN 3 END"""


@query(
    f"""WITH {inputs.VFILES}
SELECT path, length, text FROM vfiles WHERE path LIKE '%/en/%.md' OR path LIKE 'src1/%'"""
)
def scan_files(spark, sf_dir):
    """Documents written as files of their own and scanned again."""
    folder = work_folder(spark, "files")
    items = inputs.files(spark, sf_dir).select(F.col("path").alias("out_path"), F.col("text").alias("content"))
    sinks.save_per_item(items, folder, as_files=True)
    return sources.read_files(spark, folder, ("**/en/*.md", "src1/**")).select("path", "length", "text")


READ_BYTES = 4000


@query(
    f"""WITH {inputs.VFILES}, named AS (SELECT *, doc_id % 7 = 3 AS gone FROM vfiles WHERE path LIKE 'src1%' OR path LIKE '%.md')
SELECT path, CASE WHEN length > {READ_BYTES} THEN length || ' bytes are more than the {READ_BYTES} that are read' WHEN gone THEN 'gone' END AS error,
  CASE WHEN length <= {READ_BYTES} AND NOT gone THEN text END AS text FROM named"""
)
def unreadable_files(spark, sf_dir):
    """Documents as files, some too large and some gone since they were listed: these are rows with an error."""
    folder = work_folder(spark, "files")
    items = inputs.files(spark, sf_dir).select("doc_id", F.col("path").alias("out_path"), F.col("text").alias("content"))
    sinks.save_per_item(items.filter("doc_id % 7 != 3"), folder, as_files=True)
    listed = sources.list_files(spark, folder, ("src1*/**", "**/*.md"))
    gone = inputs.files(spark, sf_dir).filter("doc_id % 7 = 3").select("path", "modified", "length")
    gone = gone.filter(F.col("path").startswith("src1") | F.col("path").endswith(".md"))
    read = sources.decoded(sources.read_content(spark, listed.unionByName(gone), folder, max_bytes=READ_BYTES))
    missing = F.col("error").contains("No such file") | F.col("error").contains("does not exist")
    return read.select("path", F.when(missing, "gone").otherwise(F.col("error")).alias("error"), "text")


@query(
    f"""WITH {inputs.VFILES} SELECT '## ' || path || ' - Error reading file: ' || length || ' bytes are more than the {READ_BYTES} that are read' || chr(10) || chr(10) AS out
FROM vfiles WHERE path LIKE '%.txt' AND length > {READ_BYTES}"""
)
def unreadable_blocks(spark, sf_dir):
    """Blocks of files that are too large to be read; the others are shown as ever."""
    folder = work_folder(spark, "files")
    items = inputs.files(spark, sf_dir).select(F.col("path").alias("out_path"), F.col("text").alias("content"))
    sinks.save_per_item(items, folder, as_files=True)
    now = F.timestamp_seconds(F.lit(NOW))
    blocks = find_files_below(spark, folder, FileSpec(globs=("**/*.txt",)), now, {"max_bytes": READ_BYTES})
    return blocks.filter("error IS NOT NULL").select("out")


@query(
    """SELECT doc_id, list_count(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'The') AND regexp_matches(l, 't[b-df-hj-np-tv-z]'))) AS hits
FROM documents WHERE contains(text, 'The') AND regexp_matches(text, 'n[b-df-hj-np-tv-z][aeiou]')"""
)
def escaped_patterns(spark, sf_dir):
    """Patterns with code points and class subtraction, for files and for lines."""
    docs = inputs.table(spark, sf_dir, "documents")
    chosen = select.file_contains_all(docs, [r"\x54he", "n[a-z-[aeiou]][aeiou]"])
    hits = F.filter(F.split("text", "\n", -1), lambda line: line_hit(line, [r"\u0054he", "t[a-z-[aeiou]]"], ()))
    return chosen.select("doc_id", F.size(hits).cast("bigint").alias("hits"))


@query(
    """SELECT doc_id FROM documents WHERE contains(text, 'the') AND NOT contains(text || CASE WHEN doc_id % 3 = 0 THEN 'zq' || chr(0) ELSE '' END, 'zq')
UNION ALL SELECT doc_id FROM documents WHERE (doc_id % 3 = 0 OR contains(text, 'zq')) AND regexp_matches(text, '[Tt]he ')"""
)
def binary_content_tests(spark, sf_dir):
    """A third of the files are binary: their bytes pass or fail both kinds of content test."""
    odd = F.col("doc_id") % 3 == 0
    content = F.when(odd, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("7A7100")))).otherwise(F.encode("text", "UTF-8"))
    files = inputs.files(spark, sf_dir).select("doc_id", "path", F.when(~odd, F.col("text")).alias("text"), content.alias("content"))
    without = select.select_files(files, FileSpec(contains=("the",), not_contains=("zq",)))
    with_both = select.select_files(files, FileSpec(contains=("[Tt]he ", "zq")))
    return without.select("doc_id").unionByName(with_both.select("doc_id"))


@query(f"WITH {inputs.VFILES} SELECT doc_id, path FROM vfiles WHERE path LIKE '%/en/%.md'")
def glob_match(spark, sf_dir):
    files = inputs.files(spark, sf_dir)
    return files.filter(select.any_glob(F.col("path"), ["**/en/*.md"])).select("doc_id", "path")


@query(
    f"""WITH {inputs.VFILES}, twice AS (SELECT path FROM vfiles UNION ALL SELECT path FROM vfiles)
SELECT DISTINCT path, {_GLOB_ORD} AS glob_ord FROM twice WHERE {_GLOB_ORD} IS NOT NULL"""
)
def glob_union_distinct(spark, sf_dir):
    paths = inputs.files(spark, sf_dir).select("path")
    return select.glob_union_distinct(paths.unionByName(paths), GLOBS)


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, path FROM vfiles
WHERE NOT path LIKE 'src2/fr/%' AND NOT regexp_matches(path, 'doc[0-9]*7\\.') AND NOT path LIKE '%.html'"""
)
def ignore_rules(spark, sf_dir):
    return select.ignore_rules(inputs.files(spark, sf_dir), IGNORE).select("doc_id", "path")


@query(
    f"""WITH {inputs.VFILES}, named AS (SELECT doc_id, path, string_split(path, '/')[-1] AS name FROM vfiles)
SELECT doc_id, path FROM named
WHERE NOT regexp_full_match(name, 'doc1.*\\.md') AND NOT regexp_full_match(name, 'doc.\\..*')"""
)
def exclude_names(spark, sf_dir):
    return select.exclude_names(inputs.files(spark, sf_dir), EXCLUDE[:2]).select("doc_id", "path")


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, path FROM vfiles WHERE path NOT IN (
  SELECT path FROM vfiles WHERE path LIKE 'src3/%.txt' OR path LIKE 'src4/%')"""
)
def exclude_globs(spark, sf_dir):
    return select.exclude_globs(inputs.files(spark, sf_dir), ["src3/**/*.txt", "src4/"]).select("doc_id", "path")


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, path FROM vfiles WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def exclude_paths(spark, sf_dir):
    files = inputs.files(spark, sf_dir)
    flagged = inputs.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    excluded = files.select("doc_id", "path").join(flagged, "doc_id", "left_semi")
    return select.exclude_paths(files, excluded).select("doc_id", "path")


@query("SELECT doc_id FROM documents WHERE contains(text, 'ing') AND regexp_matches(text, '[Tt]he.*\\n?and')")
def file_contains_all(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return select.file_contains_all(docs, ["ing", "[Tt]he.*\n?and"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT (contains(text, 'Ich') OR regexp_matches(text, 'l[ae]s? '))")
def file_not_contains_any(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return select.file_not_contains_any(docs, ["Ich", "l[ae]s? "]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang <> 'de' AND NOT contains(text, 'tion')")
def unreadable_excluded(spark, sf_dir):
    """Texts of one language count as unreadable, that is null."""
    readable = F.when(F.col("lang") != "de", F.col("text"))
    docs = inputs.table(spark, sf_dir, "documents").withColumn("text", readable)
    return select.file_not_contains_any(docs, ["tion"]).select("doc_id")


REQUESTS = (
    FileSpec(globs=("**/en/*.md",), contains=("the",)),
    FileSpec(globs=("**/*.md", "**/*.py"), contains=("no such words anywhere",)),
    FileSpec(globs=("lost/**",)),
    FileSpec(globs=("**/*.md",), exclude=("doc*",)),
)


@query(
    f"""WITH {inputs.VFILES}, counts AS (
  SELECT 0 AS request, '**/en/*.md' AS pattern, count(*) FILTER (path LIKE '%/en/%.md') AS found,
         count(*) FILTER (path LIKE '%/en/%.md' AND contains(text, 'the')) AS passed FROM vfiles
  UNION ALL
  SELECT 1, '**/*.md **/*.py', count(*) FILTER (path LIKE '%.md' OR path LIKE '%.py'),
         count(*) FILTER ((path LIKE '%.md' OR path LIKE '%.py') AND contains(text, 'no such words anywhere')) FROM vfiles
  UNION ALL
  SELECT 2, 'lost/**', count(*) FILTER (path LIKE 'lost/%'), count(*) FILTER (path LIKE 'lost/%') FROM vfiles
  UNION ALL
  SELECT 3, '**/*.md', 0, 0)
SELECT request, found, passed, CASE
  WHEN found = 0 THEN '## Pattern: ' || pattern || chr(10) || chr(10) || ' - No files found' || chr(10)
  WHEN passed = 0 THEN '## Pattern: ' || pattern || chr(10) || chr(10) || ' - No files matched criteria' || chr(10)
  END AS notice FROM counts"""
)
def no_match_notice(spark, sf_dir):
    return select.no_match_notice(inputs.files(spark, sf_dir), REQUESTS)


@query(
    f"""WITH {inputs.VFILES}, n AS (SELECT count(*) AS n FROM vfiles)
SELECT doc_id, NOT (n = 1 AND path LIKE '%.html') AS wrap FROM vfiles, n"""
)
def wrap_decision(spark, sf_dir):
    files = inputs.files(spark, sf_dir).select("doc_id", "path")
    return select.wrap_decision(files, F.col("path").endswith(".html")).select("doc_id", "wrap")


_TITLE = "trim(regexp_replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '[ \\t\\n\\f\\r]+', ' ', 'g'))"


@query(
    f"""WITH named AS (SELECT page_id, {_TITLE} AS title, html FROM pages)
SELECT page_id, title, (length(title) - length(replace(title, ' ', '')))::INT AS spaces FROM named
WHERE contains(lower(title), 'tionth') OR contains(lower(html), 'tionth')"""
)
def keyword_find(spark, sf_dir):
    from ..functions.htmltext import page_title

    pages = inputs.table(spark, sf_dir, "pages").withColumn("title", page_title(F.col("html")))
    return select.keyword_find(pages, "TIONth", "title", "html").select("page_id", "title", "spaces")


@query("SELECT doc_id, (doc_id % 3 = 0 OR contains(text, chr(0))) AS is_binary FROM documents")
def binary_flag(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("4100"))).otherwise(F.unhex(F.lit("41")))
    content = F.concat(F.encode("text", "UTF-8"), tail, F.encode("lang", "UTF-8"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", sources.binary_flag(content).alias("is_binary"))


@query(
    """SELECT doc_id, text || CASE WHEN doc_id % 3 = 1 THEN chr(65533) || 'z' ELSE '' END AS text FROM documents"""
)
def text_decode(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    broken = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FF7A"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(mark, F.encode("text", "UTF-8"), broken)
    return inputs.table(spark, sf_dir, "documents").select("doc_id", sources.text_decode(content).alias("text"))


IMAGE_NAMES = ("jpg", "txt", "PNG", "gif", "bmp", "jpeg", "md")


@query(
    """WITH named AS (
  SELECT doc_id, ['jpg','txt','PNG','gif','bmp','jpeg','md'][(doc_id % 7)::INT + 1] AS ext,
         ['FFD8FF','89504E47','474946','424D',''][(doc_id % 5)::INT + 1] AS head, text, strlen(text) AS n FROM documents)
SELECT doc_id, CASE WHEN head = 'FFD8FF' THEN 'image/jpg' WHEN head = '89504E47' THEN 'image/png'
  WHEN head = '474946' THEN 'image/gif' WHEN head = '424D' AND n >= 2 THEN 'image/bmp'
  WHEN head = '' AND n >= 4 AND starts_with(text, 'BM') THEN 'image/bmp'
  WHEN head = '' AND n >= 4 AND starts_with(text, 'GIF') THEN 'image/gif'
  WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpg' WHEN ext = 'PNG' THEN 'image/png' WHEN ext = 'gif' THEN 'image/gif'
  WHEN ext = 'bmp' THEN 'image/bmp' END AS kind FROM named"""
)
def image_type(spark, sf_dir):
    heads = F.array(*(F.unhex(F.lit(h)) for h in ("FFD8FF", "89504E47", "474946", "424D", "")))
    head = F.get(heads, (F.col("doc_id") % 5).cast("int"))
    content = F.concat(head, F.encode("text", "UTF-8"))
    kind = sources.image_type(inputs.doc_path(IMAGE_NAMES), content)
    return inputs.table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))
