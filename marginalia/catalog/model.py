"""Registered queries: instructions, prompts, the model surface. The model here answers with a digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert, model
from ..operators.criteria import exclude_by_table, match_files, match_pages
from ..operators.sinks import save_history
from ..plans.report import Command, chat_history
from ..plans.report import chained_report as chain
from ..session import work_folder
from ..spec import Instruction
from . import inputs
from .registry import query

FILE_INSTRUCTIONS = (
    Instruction("Say it in short"),
    Instruction("Convert to YAML", "json"),
    Instruction("Explain the code", "py"),
    Instruction("Only this one", "src0/fr/doc0.md"),
)
PAGE_INSTRUCTIONS = (
    Instruction("Summarise for {searchTerms} and {q}"),
    Instruction("Find the author of {query}, {terms}", "example.net"),
    Instruction("Nothing to do", "no.such.site"),
)


@query(
    f"""WITH {inputs.VFILES}, rules(ord, criteria, instruction) AS (VALUES (0, '', 'Say it in short'), (1, 'json', 'Convert to YAML'),
  (2, 'py', 'Explain the code'), (3, 'src0/fr/doc0.md', 'Only this one'))
SELECT doc_id, ord, criteria, instruction FROM vfiles, rules
WHERE criteria = '' OR ends_with(path, '.' || criteria) OR path = criteria"""
)
def match_file_instr(spark, sf_dir):
    matching = model.instructions_for_file(F.col("path"), FILE_INSTRUCTIONS)
    return model.match_rows(inputs.files(spark, sf_dir), matching, "doc_id")


@query(
    """WITH rules(ord, criteria, instruction) AS (VALUES (0, '', 'Summarise for {searchTerms} and {q}'),
  (1, 'example.net', 'Find the author of {query}, {terms}'), (2, 'no.such.site', 'Nothing to do'))
SELECT page_id, ord, criteria, instruction FROM pages, rules WHERE criteria = '' OR contains(url, '.' || criteria) OR url = criteria"""
)
def match_page_instr(spark, sf_dir):
    matching = model.instructions_for_page(F.col("url"), PAGE_INSTRUCTIONS)
    return model.match_rows(inputs.table(spark, sf_dir, "pages"), matching, "page_id")


@query(
    f"""WITH {inputs.VFILES}, rules AS (
  SELECT nation.n_nationkey AS ord, CASE n_nationkey % 4 WHEN 0 THEN ['md', 'txt', 'json', 'x'][(n_nationkey // 4 % 4 + 1)::INT] WHEN 1 THEN 'src1/fr/doc' || n_nationkey || '.txt'
      WHEN 2 THEN '' ELSE lower(n_name) END AS criteria, n_name AS instruction FROM nation WHERE n_nationkey < 20
  UNION ALL SELECT 100 + doc_id, path, 'own' FROM vfiles WHERE doc_id % 3 = 0)
SELECT doc_id, ord, criteria, instruction FROM vfiles, rules WHERE criteria = '' OR ends_with(path, '.' || criteria) OR path = criteria"""
)
def match_file_table(spark, sf_dir):
    """Instructions of a table, one for every third file among them, matched to paths."""
    key = F.col("n_nationkey")
    some = F.get(F.array(*map(F.lit, ("md", "txt", "json", "x"))), (key / 4).cast("int") % 4)
    criteria = F.when(key % 4 == 0, some).when(key % 4 == 1, F.concat(F.lit("src1/fr/doc"), key.cast("string"), F.lit(".txt")))
    criteria = criteria.when(key % 4 == 2, F.lit("")).otherwise(F.lower("n_name"))
    nations = inputs.table(spark, sf_dir, "nation").filter("n_nationkey < 20")
    rules = nations.select(key.cast("bigint").alias("ord"), criteria.alias("criteria"), F.col("n_name").alias("instruction"))
    files = inputs.files(spark, sf_dir).select("doc_id", "path")
    own = files.filter("doc_id % 3 = 0").select((F.col("doc_id") + 100).alias("ord"), F.col("path").alias("criteria"), F.lit("own").alias("instruction"))
    return match_files(files, rules.unionByName(own)).drop("path")


@query(
    """WITH rules AS (
  SELECT page_id AS ord, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '[.]([^/]+)', 1) WHEN 1 THEN url WHEN 2 THEN 'example.org/e' ELSE 'no' || page_id || '.site' END AS criteria,
         'rule ' || page_id AS instruction FROM pages WHERE page_id % 5 = 0)
SELECT page_id, ord, criteria, instruction FROM pages, rules WHERE criteria = '' OR contains(url, '.' || criteria) OR url = criteria"""
)
def match_page_table(spark, sf_dir):
    """Instructions of a table made from every fifth page, matched to URLs."""
    pages, page_id = inputs.table(spark, sf_dir, "pages").select("page_id", "url"), F.col("page_id")
    criteria = (
        F.when(page_id % 4 == 0, F.regexp_extract("url", "[.]([^/]+)", 1)).when(page_id % 4 == 1, F.col("url"))
        .when(page_id % 4 == 2, F.lit("example.org/e")).otherwise(F.concat(F.lit("no"), page_id.cast("string"), F.lit(".site")))
    )
    rules = pages.filter("page_id % 5 = 0").select(
        page_id.alias("ord"), criteria.alias("criteria"), F.concat(F.lit("rule "), page_id.cast("string")).alias("instruction")
    )
    return match_pages(pages, rules).drop("url")


@query(
    f"""WITH {inputs.VFILES}, rules AS (
  SELECT CASE doc_id % 3 WHEN 0 THEN upper(path) WHEN 1 THEN regexp_extract(path, '^[^/]*/[^/]*/') ELSE '*.html' END AS line FROM vfiles WHERE doc_id % 40 = 1)
SELECT doc_id FROM vfiles WHERE NOT EXISTS (SELECT 1 FROM rules WHERE lower(line) = lower(path)
  OR (ends_with(line, '/') AND starts_with(path, line)) OR (starts_with(line, '*') AND ends_with(path, line[2:])))"""
)
def ignore_table(spark, sf_dir):
    """Files that a table of paths, folders and endings does not exclude."""
    files, doc_id = inputs.files(spark, sf_dir).select("doc_id", "path"), F.col("doc_id")
    folder = F.concat(F.substring_index("path", "/", 2), F.lit("/"))
    line = F.when(doc_id % 3 == 0, F.upper("path")).when(doc_id % 3 == 1, folder).otherwise(F.lit("*.html"))
    return exclude_by_table(files, files.filter("doc_id % 40 = 1").select(line.alias("line"))).select("doc_id")


@query(
    """SELECT page_id, 'Summarise for ' || url || ' and ' || url || '; by ' || url || ', ' || url AS instruction FROM pages"""
)
def query_substitution(spark, sf_dir):
    text = F.lit("Summarise for {searchTerms} and {q}; by {query}, {terms}")
    out = model.query_substitution(text, F.col("url"))
    return inputs.table(spark, sf_dir, "pages").select("page_id", out.alias("instruction"))


def _prompt_sql(content: str, instruction: str, ticks: str) -> str:
    parts = (
        "'Markdown:' || chr(10) || chr(10)", ticks, "chr(10)", content, "chr(10)", ticks,
        "chr(10) || chr(10) || 'Instructions:' || chr(10) || chr(10)", ticks, "chr(10)", instruction, "chr(10)", ticks,
        "chr(10) || chr(10) || 'Result after applying instructions (do not enclose in backticks):' || chr(10)",
    )
    return "(" + " || ".join(parts) + ")"


@query(
    f"""WITH ticked AS (SELECT *, text || chr(10) || repeat('`', (doc_id % 9)::INT) AS content,
  repeat('`', greatest(3, doc_id % 9 + 1)::INT + 3) AS ticks FROM documents)
SELECT doc_id, {_prompt_sql('content', "'Translate from ' || lang", 'ticks')} AS prompt FROM ticked"""
)
def prompt_render(spark, sf_dir):
    content = F.concat("text", F.lit("\n"), F.repeat(F.lit("`"), (F.col("doc_id") % 9).cast("int")))
    prompt = model.prompt_render(content, F.concat(F.lit("Translate from "), "lang"))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


def digest_model():
    """A stand-in for a model: the digest of the prompt."""
    from hashlib import md5

    return lambda system, user: "digest " + md5(user.encode()).hexdigest()


def _digest_sql(content: str, instruction: str, ticks: str = "repeat('`', 6)") -> str:
    return f"('digest ' || md5({_prompt_sql(content, instruction, ticks)}))"


@query(
    f"""WITH once AS (SELECT doc_id, {_digest_sql('text', "'Summarise'")} AS text FROM documents)
SELECT doc_id, {_digest_sql('text', "'Translate'")} AS out FROM once"""
)
def instruction_chain(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return model.instruction_chain(docs, "text", ["Summarise", "Translate"], digest_model).select("doc_id", "out")


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, CASE WHEN path LIKE '%.json' THEN {_digest_sql('text', "'Convert to YAML'")} ELSE text END AS out FROM vfiles"""
)
def file_instructions(spark, sf_dir):
    texts = F.transform(
        model.instructions_for_file(F.col("path"), FILE_INSTRUCTIONS[1:2]), lambda i: i["instruction"]
    )
    return model.apply_instructions(inputs.files(spark, sf_dir), "text", texts, digest_model).select("doc_id", "out")


@query(
    f"""WITH joined AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1)
SELECT conv_id, {_digest_sql('content', "'Give a verdict'")} AS out FROM joined"""
)
def report_instruction(spark, sf_dir):
    items = inputs.table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("ord"), F.concat("role", F.lit(": "), "text").alias("out")
    )
    return model.report_instruction(items, "conv_id", ["Give a verdict"], digest_model)


@query(
    """SELECT event_id, CASE
  WHEN event_id % 5 = 0 THEN props || chr(10) || chr(10) || '## Error Applying Instructions' || chr(10) || chr(10) || 'EXIT CODE: ' || (event_id % 3)
    || chr(10) || chr(10) || 'ERROR: call ' || event_type || ' broke' || chr(10) || chr(10) || 'STDERR: ' || event_type
  WHEN event_id % 3 <> 0 THEN props || chr(10) || chr(10) || '## Error Applying Instructions' || chr(10) || chr(10) || 'EXIT CODE: ' || (event_id % 3)
    || chr(10) || chr(10) || 'STDERR: ' || event_type
  ELSE props END AS out FROM events"""
)
def error_section(spark, sf_dir):
    event = F.col("event_id")
    error = F.when(event % 5 == 0, F.concat(F.lit("call "), "event_type", F.lit(" broke")))
    out = model.error_section(F.col("props"), (event % 3).cast("int"), error, F.col("event_type"))
    return inputs.table(spark, sf_dir, "events").select("event_id", out.alias("out"))


def failing_model():
    """Fails by content: at the first call of a prompt, at each call with a code, or by an exception."""
    from ..operators.model import Reply

    seen = set()

    def ask(system, user):
        if "kind 1" in user and user not in seen:
            seen.add(user)
            return Reply("half", 1, "again")
        if "kind 2" in user:
            return Reply("partly", 7, "broken pipe")
        if "kind 3" in user:
            raise RuntimeError("no line")
        return "done"

    return ask


@query(
    """SELECT event_id, CASE event_id % 4
  WHEN 2 THEN 'partly' || chr(10) || chr(10) || '## Error Applying Instructions' || chr(10) || chr(10) || 'EXIT CODE: 7' || chr(10) || chr(10) || 'STDERR: broken pipe'
  WHEN 3 THEN chr(10) || chr(10) || '## Error Applying Instructions' || chr(10) || chr(10) || 'EXIT CODE: 0' || chr(10) || chr(10) || 'ERROR: no line' || chr(10) || chr(10) || 'STDERR: '
  ELSE 'done' END AS out FROM events"""
)
def retry_error(spark, sf_dir):
    """A model that fails once, always or by an exception, through retries."""
    kind = F.concat(F.lit("kind "), (F.col("event_id") % 4).cast("string"), F.lit(" of "), F.col("event_id").cast("string"))
    events = inputs.table(spark, sf_dir, "events").select("event_id", kind.alias("text"))
    return model.instruction_chain(events, "text", ["go"], failing_model).select("event_id", "out")


CHAIN_BYTES = 4096
_CHAIN_STEPS = {0: "Summarise it", 1: "List the commands"}
_OWN_STEP = "CASE cmd " + " ".join(f"WHEN {c} THEN '{text}'" for c, text in _CHAIN_STEPS.items()) + " END"

# Each level joins what is left of a command in pieces and answers them, until the command has one answer.
_CHAIN = f"""WITH RECURSIVE {inputs.VFILES}, {inputs.VCMD}, folded AS (
  SELECT 0 AS cmd, 0 AS level, doc_id AS ord, path AS out FROM vfiles UNION ALL SELECT 1, 0, run_id, script FROM vcmd
  UNION ALL
  SELECT cmd, level + 1, piece, {_digest_sql("string_agg(out, chr(10) ORDER BY ord)", _OWN_STEP)} FROM (
    SELECT *, coalesce(sum(strlen(out) + 1) OVER (PARTITION BY cmd ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {CHAIN_BYTES // 2} AS piece,
           count(*) OVER (PARTITION BY cmd) AS n FROM folded)
  WHERE level = 0 OR n > 1 GROUP BY cmd, level, piece)"""


def _chain(spark, sf_dir):
    return chain(
        [
            Command(
                inputs.files(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("path").alias("out")),
                (_CHAIN_STEPS[0],),
            ),
            Command(
                inputs.commands(spark, sf_dir).select(F.col("run_id").alias("ord"), F.col("script").alias("out")),
                (_CHAIN_STEPS[1],),
            ),
            inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("out")),
        ],
        digest_model,
        CHAIN_BYTES,
        slice_items=1000,
    )


@query(
    f"""{_CHAIN}
SELECT cmd, 0 AS part, 0 AS piece, arg_max(out, level) AS text FROM folded GROUP BY cmd
UNION ALL SELECT 2, page_id // 1000, 0, string_agg(url, chr(10) ORDER BY page_id) FROM pages GROUP BY ALL"""
)
def chained_report(spark, sf_dir):
    """One report over files, commands and pages; the first two have an instruction each, which sees their outputs only."""
    return _chain(spark, sf_dir).pieces


@query(
    f"""{_CHAIN}
SELECT lpad(cmd::VARCHAR, 9, '0') || '/000000000/' || lpad((level - 1)::VARCHAR, 9, '0') || '/' || lpad(ord::VARCHAR, 9, '0') AS conv_id, out AS text
FROM folded WHERE level > 0"""
)
def chained_history(spark, sf_dir):
    """What the model said at each level of the same report, read back from the chat history that was saved."""
    folder = work_folder(spark, "chain-history")
    target = save_history(chat_history(_chain(spark, sf_dir).exchanges), folder, "0")
    said = spark.read.schema("conv_id string, role string, content string").json(target)
    return said.filter("role = 'assistant'").select("conv_id", F.col("content").alias("text"))


def _describe(path: str, content: bytes) -> str:
    return f"{path} holds {len(content)} bytes"


@query(
    f"""WITH {inputs.VFILES}
SELECT doc_id, CASE WHEN path LIKE '%.json' OR path LIKE '%.cs' THEN path || ' holds ' || length || ' bytes' ELSE '' END AS text FROM vfiles"""
)
def convert_dispatch(spark, sf_dir):
    files = inputs.files(spark, sf_dir).select("doc_id", "path", F.encode("text", "UTF-8").alias("content"))
    return convert.convert_dispatch(files, {".JSON": _describe, ".cs": _describe}).select("doc_id", "text")
