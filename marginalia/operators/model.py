"""Prompts and a caller's model, applied row by row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import fence_len
from ..session import materialize
from ..spec import Instruction
from .joins import join_keys
from .report import bounded_pieces

# The prompt texts.
SYSTEM_PROMPT = """\
You are a helpful AI assistant.

You will be provided with one or more files or search results, and a set of instructions.

Your task is to apply the instructions to the text and return the result.
"""
USER_PROMPT = """\
Markdown:

{backticks}
{content}
{backticks}

Instructions:

{backticks}
{instructions}
{backticks}

Result after applying instructions (do not enclose in backticks):
"""

RETRIES = 1
PROMPT_BYTES = 1 << 20
_PIECES = re.split(r"(\{backticks\}|\{content\}|\{instructions\})", USER_PROMPT)


class Reply(NamedTuple):
    """What a model call gave back; a plain string counts as a reply without failure."""

    text: str
    exit_code: int = 0
    stderr: str = ""


Model = Callable[[str, str], "Reply | str"]


def prompt_render(content: Column, instruction: Column, ticks: Column | None = None) -> Column:
    """The user prompt; its fence is three ticks longer than the content needs."""
    ticks = F.repeat(F.lit("`"), (fence_len(content) if ticks is None else ticks) + 3)
    values = {"{backticks}": ticks, "{content}": content, "{instructions}": instruction}
    return F.concat(*(values.get(p, F.lit(p)) for p in _PIECES if p))


def query_substitution(instruction: Column, query: Column) -> Column:
    for name in ("{searchTerms}", "{query}", "{terms}", "{q}"):
        instruction = F.replace(instruction, F.lit(name), query)
    return instruction


def file_criteria(path: Column, criteria: str) -> Column:
    if not criteria:
        return F.lit(True)
    return path.endswith(F.lit("." + criteria)) | (path == F.lit(criteria))


def page_criteria(url: Column, criteria: str) -> Column:
    if not criteria:
        return F.lit(True)
    return url.contains(F.lit("." + criteria)) | (url == F.lit(criteria))


def _matching(instructions: Sequence[Instruction], applies: Callable[[str], Column]) -> Column:
    shown = lambda i, x: F.struct(
        F.lit(i).alias("ord"), F.lit(x.criteria).alias("criteria"), F.lit(x.text).alias("instruction")
    )
    if not instructions:
        return F.expr("cast(array() as array<struct<ord: int, criteria: string, instruction: string>>)")
    return F.array_compact(
        F.array(*(F.when(applies(x.criteria), shown(i, x)) for i, x in enumerate(instructions)))
    )


def instructions_for_file(path: Column, instructions: Sequence[Instruction]) -> Column:
    """The instructions that apply to a path, in order. They are options, so no join is needed."""
    return _matching(instructions, lambda criteria: file_criteria(path, criteria))


def instructions_for_page(url: Column, instructions: Sequence[Instruction], lower: bool = False) -> Column:
    """As above for a URL; a search lower-cases the criteria."""
    return _matching(instructions, lambda c: page_criteria(url, c.lower() if lower else c))


def match_rows(items: DataFrame, matching: Column, *keep: str) -> DataFrame:
    """One row per item and instruction that applies to it."""
    return items.select(*keep, F.inline(matching))


def error_section(out: Column, exit_code: Column, error: Column, stderr: Column) -> Column:
    """A failed call: what it printed, then code, error and standard error."""
    text = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(text(out), F.lit("\n\n## Error Applying Instructions\n\nEXIT CODE: "), exit_code.cast("string"))
    stderr = F.concat(F.lit("\n\nSTDERR: "), text(stderr))
    raised = F.concat(head, F.lit("\n\nERROR: "), error, stderr)
    return F.when(error.isNotNull(), raised).when(exit_code != 0, F.concat(head, stderr)).otherwise(text(out))


def _ticks(content: str) -> int:
    return max(3, max(map(len, re.findall("`+", content)), default=0) + 1)


def _user_prompt(content: str, instruction: str, ticks: int) -> str:
    values = {"{backticks}": "`" * (ticks + 3), "{content}": content, "{instructions}": instruction}
    return "".join(values.get(p, p) for p in _PIECES)


def _ask(model: Model, user: str, retries: int) -> str:
    while True:
        error, reply = None, Reply("")
        try:
            given = model(SYSTEM_PROMPT, user)
            reply = Reply(given) if isinstance(given, str) else given
        except Exception as caught:  # a failing call becomes part of the output
            error = str(caught)
        if error is None and reply.exit_code == 0:
            return reply.text
        if retries <= 0:
            break
        retries -= 1
    message = f"{reply.text}\n\n## Error Applying Instructions\n\nEXIT CODE: {reply.exit_code}"
    if error is not None:
        message += f"\n\nERROR: {error}"
    return f"{message}\n\nSTDERR: {reply.stderr}"


def apply_instructions(
    items: DataFrame,
    content: str,
    instructions: Column,
    build_model: Callable[[], Model],
    name: str = "out",
    retries: int = RETRIES,
    ticks: Column | None = None,
    history: str | None = None,
    parallelism: int | None = None,
    every_row: bool = False,
) -> DataFrame:
    """Fold an array of instruction texts over each row's content with the caller's model.

    ``build_model`` runs once per task. Only the content and the instructions cross into Python, and only
    for rows that have any. A failing call is retried, then reported inside the output. ``history`` names a
    column for the exchanges, an array of ``struct<user, assistant>``.

    Calls cost far more than bytes, so the rows with instructions are dealt to ``parallelism`` tasks (by
    default one per core or shuffle partition, whichever are more), in turn and not by their content, so that copies are
    spread too. Rows without any stay where they are, for which the items are read twice; ``every_row`` says that all
    rows have instructions.
    """

    @F.pandas_udf("answer string, users array<string>, assistants array<string>")
    def fold(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = None
        for contents, asked, sizes in batches:
            rows = []
            for current, steps, size in zip(contents, asked, sizes):
                users, answers = [], []
                if current is not None:
                    model = model or build_model()
                    for at, step in enumerate(steps):
                        width = _ticks(current) if at or pd.isna(size) else int(size)
                        user = _user_prompt(current, step, width)
                        current = _ask(model, user, retries)
                        if history:
                            users.append(user)
                            answers.append(current)
                rows.append((current, users, answers))
            yield pd.DataFrame(rows, columns=["answer", "users", "assistants"], dtype=object)

    wanted = F.size(instructions) > 0
    spark = items.sparkSession
    tasks = parallelism or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if every_row:
        items = items.repartition(tasks)
    else:
        without = items.filter(~F.coalesce(wanted, F.lit(False)))
        items = items.filter(wanted).repartition(tasks).unionByName(without)
    given = F.when(wanted, F.coalesce(F.col(content), F.lit("")))
    size = F.lit(None).cast("double") if ticks is None else ticks.cast("double")
    done = items.withColumn("__done", fold.asNondeterministic()(given, instructions, size))
    done = done.withColumn(name, F.when(wanted, F.col("__done.answer")).otherwise(F.col(content)))
    if history:
        exchange = lambda u, a: F.struct(u.alias("user"), a.alias("assistant"))
        done = done.withColumn(history, F.zip_with("__done.users", "__done.assistants", exchange))
    return done.drop("__done")


def chat_messages(items: DataFrame, key: str, history: str) -> DataFrame:
    """Recorded exchanges as message rows ``(conv_id, turn, role, text)``, one conversation per call."""
    said = items.select(F.col(key).alias("item"), F.posexplode(history).alias("step", "exchange"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    messages = F.array(
        message("system", F.lit(SYSTEM_PROMPT)),
        message("user", F.col("exchange.user")),
        message("assistant", F.col("exchange.assistant")),
    )
    conversation = F.concat_ws("/", F.col("item").cast("string"), F.col("step").cast("string")).alias("conv_id")
    return said.select(conversation, F.posexplode(messages).alias("turn", "message")).select(
        "conv_id", "turn", "message.*"
    )


def instruction_chain(
    items: DataFrame, content: str, instructions: Sequence[str], build_model: Callable[[], Model], **options
) -> DataFrame:
    texts = F.array(*(F.lit(t) for t in instructions)) if instructions else F.expr("cast(array() as array<string>)")
    return apply_instructions(items, content, texts, build_model, every_row=bool(instructions), **options)


def fold_instruction(
    items: DataFrame,
    keys: Sequence[str],
    instruction: str,
    build_model: Callable[[], Model],
    order: str = "ord",
    out: str = "out",
    limit: int = PROMPT_BYTES,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """One answer ``(keys, out)`` per report, and the exchanges ``(keys, level, piece, user, assistant)`` that led to it.

    A report of ``limit`` bytes at most is one prompt. A longer one is asked in pieces of that size, and the answers, joined
    in order, are a report again that is asked in the same way, level by level, until one answer is left. So no value
    is longer than the limit, whatever a report holds, and a report's answers never meet those of another one.
    Answers have to be shorter than what they answer: an error says so if the number of pieces stops falling.
    """
    answers, exchanges, before = [], [], None
    rows = items.select(*keys, F.col(order).alias("ord"), F.col(out).alias("out"))
    while True:
        pieces = bounded_pieces(rows, keys, "ord", "out", limit)
        asked = instruction_chain(pieces, "text", [instruction], build_model, name="answer", history="said", **options)
        given = materialize(asked.select(*keys, "piece", "answer", "said"), "answers")
        said = given.select(*keys, F.lit(len(answers)).alias("level"), "piece", F.inline("said"))
        exchanges.append(said)
        several = given.filter("piece = 1").select(*keys)
        left = join_keys(given, several, keys, "left_semi")
        answers.append(join_keys(given, several, keys, "left_anti").select(*keys, F.col("answer").alias("out")))
        now = left.count()
        if not now:
            return reduce(DataFrame.unionByName, answers), reduce(DataFrame.unionByName, exchanges)
        if before is not None and now >= before:
            raise ValueError(f"answers are as long as what they answer: {now} pieces are left of {before}")
        before, rows = now, left.select(*keys, F.col("piece").alias("ord"), F.col("answer").alias("out"))


def fold_instructions(
    items: DataFrame,
    keys: Sequence[str],
    instructions: Sequence[str],
    build_model: Callable[[], Model],
    order: str = "ord",
    out: str = "out",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Apply instructions one after the other to each report: its answer to one is the report for the next.

    Returns answers ``(keys, out)`` and exchanges ``(keys, step, level, piece, user, assistant)``.
    """
    rows, exchanges = items.select(*keys, F.col(order).alias("ord"), F.col(out).alias("out")), []
    for step, instruction in enumerate(instructions):
        answers, said = fold_instruction(rows, keys, instruction, build_model, **options)
        exchanges.append(said.withColumn("step", F.lit(step)))
        rows = answers.select(*keys, F.lit(0).alias("ord"), "out")
    return rows.select(*keys, "out"), reduce(DataFrame.unionByName, exchanges)


def report_instruction(
    items: DataFrame,
    key: str,
    instructions: Sequence[str],
    build_model: Callable[[], Model],
    order: str = "ord",
    out: str = "out",
    **options,
) -> DataFrame:
    """Apply instructions to the combined output of each report, as ``(key, out)``; see ``fold_instruction``.

    A report is asked in pieces of ``limit`` bytes, so it may be of any size. Items of one ordinal come in the order of
    their first characters. Reports without any output have no answer; a null key is a report of its own.
    """
    if not instructions:
        raise ValueError("there is no instruction to apply")
    answers, _ = fold_instructions(items, [key], instructions, build_model, order, out, **options)
    return answers.withColumnRenamed("out", out)
