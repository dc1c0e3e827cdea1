"""Registered queries: markdown pieces, paths, names, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown, paths
from ..operators.names import unique_slug as distinct_names
from ..operators.report import combined_output as combine
from ..operators.report import union_commands as union_all
from ..plans.find_files import file_blocks, find_files
from ..plans.find_files import find_files_report as find_all
from ..plans.run_log import run_blocks, run_report as combined_runs
from ..spec import FileSpec, LineSpec
from . import inputs
from .registry import query

NOW = 1706000000
_TICKED = "(text || chr(10) || repeat('`', (doc_id % 9)::INT) || ' x ``')"
_LONGEST = f"coalesce(list_max(list_transform(regexp_extract_all({_TICKED}, '`+'), lambda x: length(x))), 0)"
_FENCE = f"greatest(3, {_LONGEST} + 1)"


def _ticked(spark, sf_dir):
    """Files whose text ends in backtick runs of changing length."""
    runs = F.repeat(F.lit("`"), (F.col("doc_id") % 9).cast("int"))
    return inputs.files(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), runs, F.lit(" x ``")))


@query(f"SELECT doc_id, {_FENCE}::INT AS fence_len FROM documents")
def fence_len(spark, sf_dir):
    return _ticked(spark, sf_dir).select("doc_id", markdown.fence_len(F.col("text")).alias("fence_len"))


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, CASE WHEN path LIKE '%.md' OR doc_id % 11 = 0 THEN repeat('`', {_FENCE}::INT) ELSE '```' END AS fence
FROM vfiles"""
)
def fence_choice(spark, sf_dir):
    binary = F.col("doc_id") % 11 == 0
    ticks = markdown.fence_choice(F.col("path"), F.col("text"), binary)
    return _ticked(spark, sf_dir).select("doc_id", ticks.alias("fence"))


_SIZE = """CASE WHEN {n} >= 1073741824 THEN ({n} // 1073741824) || ' GB' WHEN {n} >= 1048576 THEN ({n} // 1048576) || ' MB'
  WHEN {n} >= 1024 THEN ({n} // 1024) || ' KB' ELSE {n} || ' bytes' END"""


@query(f"WITH {inputs.VFILES}, big AS (SELECT doc_id, length * (1 + (doc_id % 4)) ** 9 AS n FROM vfiles) SELECT doc_id, {_SIZE.format(n='n::BIGINT')} AS size FROM big")
def friendly_size(spark, sf_dir):
    length = F.col("length") * F.pow(1 + F.col("doc_id") % 4, F.lit(9)).cast("bigint")
    return inputs.files(spark, sf_dir).select("doc_id", markdown.friendly_size(length).alias("size"))


def _age_sql(modified: str) -> str:
    return f"""CASE WHEN {NOW} - {modified} < 60 THEN 'just now' WHEN ({NOW} - {modified}) // 60 = 1 THEN '1 minute ago'
  WHEN ({NOW} - {modified}) // 60 < 60 THEN (({NOW} - {modified}) // 60) || ' minutes ago'
  WHEN ({NOW} - {modified}) // 3600 = 1 THEN '1 hour ago'
  WHEN ({NOW} - {modified}) // 3600 < 24 THEN (({NOW} - {modified}) // 3600) || ' hours ago'
  WHEN ({NOW} - {modified}) // 86400 = 1 THEN '1 day ago'
  WHEN ({NOW} - {modified}) // 86400 < 7 THEN (({NOW} - {modified}) // 86400) || ' days ago'
  ELSE strftime(make_timestamp(({modified}) * 1000000), '%m/%d/%Y %H:%M:%S') END"""


@query(f"SELECT doc_id, {_age_sql(f'({NOW} + 30 - doc_id * doc_id * 3)')} AS age FROM documents")
def friendly_age(spark, sf_dir):
    modified = F.timestamp_seconds(F.lit(NOW + 30) - F.col("doc_id") * F.col("doc_id") * 3)
    age = markdown.friendly_age(modified, F.timestamp_seconds(F.lit(NOW)))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", age.alias("age"))


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, CASE string_split(path, '.')[-1] WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'plaintext' WHEN 'py' THEN 'python'
  WHEN 'json' THEN 'json' WHEN 'html' THEN 'html' WHEN 'cs' THEN 'csharp' END AS lang FROM vfiles"""
)
def lang_tag(spark, sf_dir):
    return inputs.files(spark, sf_dir).select("doc_id", markdown.lang_tag(F.col("path")).alias("lang"))


_NAMES = """named AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'doc' || doc_id || '.tar.gz' WHEN 1 THEN 'a b/c/doc' || doc_id
    WHEN 2 THEN 'x/.doc' || doc_id WHEN 3 THEN 'x.y/doc' || doc_id || '.' ELSE source || '/doc' || doc_id || '.md' END AS path
  FROM documents),
parts AS (
  SELECT doc_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir,
         string_split(path, '/')[-1] AS name FROM named),
split AS (
  SELECT *, CASE WHEN contains(name, '.') AND NOT ends_with(name, '.') THEN '.' || string_split(name, '.')[-1] ELSE '' END AS ext,
         CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS base FROM parts)"""


def _named(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("doc"), number, F.lit(".tar.gz")))
        .when(kind == 1, F.concat(F.lit("a b/c/doc"), number))
        .when(kind == 2, F.concat(F.lit("x/.doc"), number))
        .when(kind == 3, F.concat(F.lit("x.y/doc"), number, F.lit(".")))
        .otherwise(F.concat("source", F.lit("/doc"), number, F.lit(".md")))
    )
    return inputs.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query(f"WITH {_NAMES} SELECT doc_id, dir, base, ext FROM split")
def path_parts(spark, sf_dir):
    path = F.col("path")
    return _named(spark, sf_dir).select(
        "doc_id", paths.directory(path).alias("dir"), paths.file_base(path).alias("base"), paths.extension(path).alias("ext")
    )


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, CASE WHEN starts_with(lower(path), 'src1/') THEN substr(path, 6) ELSE path END AS path FROM vfiles"""
)
def relative_path(spark, sf_dir):
    return inputs.files(spark, sf_dir).select("doc_id", paths.relative_path(F.col("path"), "SRC1").alias("path"))


TEMPLATE = "/{filePath}/{filebase}-{timeStamp}-{time}.{fileExt}.out of {fileName}/"


@query(
    f"""WITH {_NAMES}
SELECT doc_id, trim('/' || dir || '/' || base || '-20240101000000-1704067200000.' || substr(ext, 2) || '.out of ' || path || '/', ' /\\') AS out_path
FROM split"""
)
def template_path(spark, sf_dir):
    out = paths.template_path(F.col("path"), TEMPLATE, "20240101000000", "1704067200000")
    return _named(spark, sf_dir).select("doc_id", out.alias("out_path"))


_SLUG = """trim(regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/:?#]*)', 1))
  || regexp_extract({u}, '^[a-z]+://[^/:?#]*([^#]*)', 1), '[^A-Za-z0-9]+', '-', 'g'), '-')"""


@query(f"SELECT page_id, url, 'web-pages/' || {_SLUG.format(u='url')} AS slug FROM pages")
def url_slug(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", paths.slug_path(F.col("url")).alias("slug"))


@query(
    f"""WITH variants AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url || '#more' FROM pages
  UNION ALL SELECT page_id, regexp_replace(url, '^(https?://[^/]*).*$', '\\1/') FROM pages),
named AS (SELECT page_id, url, 'web-pages/' || {_SLUG.format(u='url')} AS slug FROM variants),
placed AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY md5(url), page_id) AS n FROM named)
SELECT page_id, url, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS name FROM placed"""
)
def unique_slug(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    home = F.regexp_replace("url", r"^(https?://[^/]*).*$", "$1/")
    variants = F.array("url", F.concat("url", F.lit("#more")), home)
    return distinct_names(pages.select("page_id", F.explode(variants).alias("url"))).select("page_id", "url", "name")


_FACTS = f"chr(10) || chr(10) || 'Modified: ' || {_age_sql('mtime_s')} || chr(10) || 'Size: ' || {_SIZE.format(n='length')} || chr(10) || chr(10)"
_LANG = """CASE string_split(path, '.')[-1] WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'plaintext' WHEN 'py' THEN 'python'
  WHEN 'json' THEN 'json' WHEN 'html' THEN 'html' ELSE 'csharp' END"""


@query(
    f"""WITH {inputs.VFILES}, fenced AS (
  SELECT *, CASE WHEN path LIKE '%.md' THEN repeat('`', {_FENCE}::INT) ELSE '```' END AS ticks, {_TICKED} AS body FROM vfiles)
SELECT doc_id, '## ' || path || {_FACTS} || ticks || {_LANG} || chr(10) || body || chr(10) || ticks || chr(10) AS out FROM fenced"""
)
def file_block(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(NOW))
    return file_blocks(_ticked(spark, sf_dir), LineSpec(), now).select("doc_id", "out")


@query(
    f"""SELECT doc_id, '## (stdin)' || chr(10) || chr(10) || repeat('`', {_FENCE}::INT) || chr(10) || {_TICKED} || chr(10)
  || repeat('`', {_FENCE}::INT) || chr(10) AS out FROM documents"""
)
def unnamed_block(spark, sf_dir):
    unnamed = _ticked(spark, sf_dir).withColumn("path", F.lit(markdown.STDIN))
    return file_blocks(unnamed, LineSpec(), F.timestamp_seconds(F.lit(NOW))).select("doc_id", "out")


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '## ' || path || ' - Error reading file: cannot read ' || lang || chr(10) || chr(10)
  ELSE '## ' || path || {_FACTS} || '```' || {_LANG} || chr(10) || v.text || chr(10) || '```' || chr(10) END AS out
FROM vfiles v JOIN documents USING (doc_id)"""
)
def error_block(spark, sf_dir):
    lang = F.split("path", "/")[1]
    failed = inputs.files(spark, sf_dir).withColumn(
        "error", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("cannot read "), lang))
    )
    return file_blocks(failed, LineSpec(), F.timestamp_seconds(F.lit(NOW))).select("doc_id", "out")


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_RUN = f"""rtrim(CASE WHEN contains(script, chr(10)) THEN '## Run' || chr(10) || chr(10) || 'Run:' || chr(10) || ticks || chr(10)
    || rtrim(script, {_WS}) || chr(10) || ticks || chr(10) || chr(10)
    ELSE '## `' || script || '`' || chr(10) || chr(10) END
  || 'Output:' || chr(10) || ticks || chr(10) || rtrim(output, {_WS}) || chr(10) || ticks || chr(10) || chr(10)
  || CASE WHEN exit_code <> 0 THEN 'Exit code: ' || exit_code || chr(10) || chr(10) ELSE '' END, {_WS})"""
_VRUN = f"""{inputs.VCMD},
ticked AS (SELECT *, repeat('`', greatest(3, run_id % 6 + 1)) AS ticks FROM vcmd),
blocks AS (SELECT run_id, event_type, {_RUN} AS out FROM ticked)"""


@query(f"WITH {_VRUN} SELECT run_id, out FROM blocks")
def run_block(spark, sf_dir):
    return run_blocks(inputs.commands(spark, sf_dir)).select("run_id", "out")


@query(
    f"""WITH {_VRUN}
SELECT event_type, run_id // 50 AS part, string_agg(out, chr(10) ORDER BY run_id) AS text FROM blocks GROUP BY ALL"""
)
def run_report(spark, sf_dir):
    return combined_runs(inputs.commands(spark, sf_dir), ["event_type"], slice_items=50).drop("piece")


@query(
    f"""WITH {inputs.VFILES}, shown AS (SELECT 'src' || doc_id % 2 AS report, doc_id, path || ': ' || length AS out FROM vfiles)
SELECT report, doc_id // 100 AS part, string_agg(out, chr(10) ORDER BY doc_id) AS text FROM shown GROUP BY ALL"""
)
def combined_output(spark, sf_dir):
    items = inputs.files(spark, sf_dir).select(
        F.concat(F.lit("src"), (F.col("doc_id") % 2).cast("string")).alias("report"),
        F.col("doc_id").alias("ord"),
        F.concat("path", F.lit(": "), F.col("length").cast("string")).alias("out"),
    )
    return combine(items, ["report"], slice_items=100).drop("piece")


@query(
    f"""WITH {inputs.VFILES}, {inputs.VCMD}
SELECT 0 AS cmd, doc_id AS ord, path AS out FROM vfiles UNION ALL SELECT 1, run_id, script FROM vcmd
UNION ALL SELECT 2, page_id, url FROM pages"""
)
def union_commands(spark, sf_dir):
    return union_all(
        inputs.files(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("path").alias("out")),
        inputs.commands(spark, sf_dir).select(F.col("run_id").alias("ord"), F.col("script").alias("out")),
        inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("out")),
    )


REPORT_SPEC = FileSpec(
    globs=("**/en/**", "**/*.md"),
    exclude=("src3/", "doc*7.*"),
    contains=("ing",),
    not_contains=("shwh the",),
    lines=LineSpec(include=("[Tt]he ",), remove=("erat",), before=1, after=1),
)


@query(
    f"""WITH {inputs.VFILES}, {inputs.VLINES},
chosen AS (SELECT * FROM vfiles WHERE (path LIKE '%/en/%' OR path LIKE '%.md') AND path NOT LIKE 'src3/%'
  AND NOT regexp_matches(path, '/doc[^/]*7\\.[^/]*$') AND contains(text, 'ing') AND NOT contains(text, 'shwh the')),
flagged AS (SELECT v.*, contains(line, 'erat') AS removed, regexp_matches(line, '[Tt]he ') AND NOT contains(line, 'erat') AS hit
  FROM vlines v JOIN chosen USING (doc_id)),
near AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM flagged),
kept AS (SELECT *, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS last_idx FROM near WHERE n = 1),
pieces AS (
  SELECT doc_id, idx, 0 AS piece, '```' || chr(10) || chr(10) || '```' AS out FROM kept WHERE idx > last_idx + 1
  UNION ALL SELECT doc_id, idx, 1, line FROM kept WHERE NOT removed),
joined AS (SELECT doc_id, string_agg(out, chr(10) ORDER BY idx, piece) AS body FROM pieces GROUP BY 1)
SELECT path, '## ' || path || {_FACTS} || '```' || {_LANG} || chr(10) || coalesce(body, '') || chr(10) || '```' || chr(10) AS out
FROM chosen LEFT JOIN joined USING (doc_id)"""
)
def find_files_report(spark, sf_dir):
    return find_files(inputs.files(spark, sf_dir), REPORT_SPEC, F.timestamp_seconds(F.lit(NOW))).select("path", "out")


@query(
    f"""WITH {_VRUN}, failed AS (
  SELECT run_id, CASE WHEN run_id % 10 = 3 THEN '## Error executing command: ' || script || chr(10) || chr(10) || 'no shell for ' || event_type || chr(10) ELSE out END AS out
  FROM blocks JOIN vcmd USING (run_id, event_type))
SELECT run_id, out FROM failed"""
)
def run_errors(spark, sf_dir):
    """Commands of which some could not be run at all."""
    error = F.when(F.col("run_id") % 10 == 3, F.concat(F.lit("no shell for "), "event_type"))
    return run_blocks(inputs.commands(spark, sf_dir).withColumn("error", error)).select("run_id", "out")


@query(
    f"""WITH {inputs.VFILES}, shown AS (SELECT doc_id % 3 AS report, doc_id // 4 AS ord, path || ': ' || text AS out FROM vfiles),
sized AS (SELECT *, ord // 40 AS part, coalesce(sum(strlen(out) + 1) OVER (
  PARTITION BY report, ord // 40 ORDER BY ord, out ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shown)
SELECT report, part, (before // 20000)::BIGINT AS piece, string_agg(out, chr(10) ORDER BY ord, out) AS text FROM sized GROUP BY ALL"""
)
def report_pieces(spark, sf_dir):
    """Reports with repeated ordinals, in pieces by bytes."""
    items = inputs.files(spark, sf_dir).select(
        (F.col("doc_id") % 3).alias("report"), F.expr("doc_id div 4").alias("ord"), F.concat("path", F.lit(": "), "text").alias("out")
    )
    return combine(items, ["report"], part_bytes=20000, slice_items=40)


NOTICE_SPECS = (
    FileSpec(globs=("**/en/*.md",), contains=("the",)),
    FileSpec(globs=("**/*.md", "**/*.py"), contains=("no such words anywhere",)),
    FileSpec(globs=("lost/**",)),
)


@query(
    f"""WITH {inputs.VFILES}
SELECT 0 AS request, path, '## ' || path || {_FACTS} || '```' || {_LANG} || chr(10) || text || chr(10) || '```' || chr(10) AS out
FROM vfiles WHERE path LIKE '%/en/%.md' AND contains(text, 'the')
UNION ALL SELECT 1, NULL, '## Pattern: **/*.md **/*.py' || chr(10) || chr(10) || ' - No files matched criteria' || chr(10)
UNION ALL SELECT 2, NULL, '## Pattern: lost/**' || chr(10) || chr(10) || ' - No files found' || chr(10)"""
)
def find_files_notices(spark, sf_dir):
    """Several requests in one report, those without a file as notices."""
    return find_all(inputs.files(spark, sf_dir), NOTICE_SPECS, F.timestamp_seconds(F.lit(NOW)))
