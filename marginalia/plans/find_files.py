"""Select files, search their lines, show each as a block."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import fence_choice, file_block, file_error_block, friendly_age, friendly_size
from ..operators.convert import Converter, convert_dispatch, converter_key
from ..operators.lines import shown_text
from ..operators.model import Model, apply_instructions, instructions_for_file
from ..operators.select import no_match_notice, path_selected, select_files, wrap_decision
from ..sources.files import decoded, list_files, read_content
from ..spec import FileSpec, LineSpec


def file_blocks(
    files: DataFrame, lines: LineSpec, now: Column, text: str = "text", is_binary: Column | None = None
) -> DataFrame:
    """Add ``out``: the searched text in its fence with heading and facts.

    Rows need ``path``, ``modified`` and ``length``. A file whose ``wrap`` is false and that is not filtered
    shows its bare text; text that is null shows nothing.
    """
    path = F.col("path")
    ticks = fence_choice(path, F.col(text), is_binary)
    shown = shown_text(files.withColumn("__ticks_out", ticks), lines, text, F.col("__ticks_out"), "__body")
    block = file_block(
        path,
        friendly_age(F.col("modified"), now),
        friendly_size(F.col("length")),
        F.col("__body"),
        F.col("__ticks_out"),
    )
    if "wrap" in files.columns and not (lines.filters or lines.numbers):
        block = F.when(F.col("wrap"), block).otherwise(F.col("__body"))
    if "error" in files.columns:
        failed = file_error_block(path, F.col("error"), F.lit(""))
        block = F.when(F.col("error").isNotNull(), failed).otherwise(block)
    return shown.withColumn("out", F.coalesce(block, F.lit(""))).drop("__body", "__ticks_out")


def find_files_report(files: DataFrame, specs: Sequence[FileSpec], now: Column, **options) -> DataFrame:
    """Report rows ``(request, path, out)`` of several requests.

    A request that found no file, or none that passed, has its notice with a null path instead of blocks.
    """
    report = no_match_notice(files, specs).filter(F.col("notice").isNotNull())
    report = report.select("request", F.lit(None).cast("string").alias("path"), F.col("notice").alias("out"))
    single = len(specs) == 1
    for at, spec in enumerate(specs):
        blocks = find_files(files, spec, now, single_command=single, **options)
        report = report.unionByName(blocks.select(F.lit(at).alias("request"), "path", "out"))
    return report


def find_files_below(spark: SparkSession, root: str, spec: FileSpec, now: Column, read: Mapping[str, int] | None = None, **options) -> DataFrame:
    """Blocks of the selected files below a folder: names are tested on the listing, so only what they select is read.

    A file that cannot be read shows its error; where there are content tests, it fails them and is left out.
    """
    listed = list_files(spark, root).filter(path_selected(F.col("path"), spec))
    return find_files(decoded(read_content(spark, listed, root, **(read or {}))), spec, now, **options)


def find_files(
    files: DataFrame,
    spec: FileSpec,
    now: Column,
    build_model: Callable[[], Model] | None = None,
    converters: Mapping[str, Converter] | None = None,
    single_command: bool = True,
) -> DataFrame:
    """Rows of selected files with their block in ``out``.

    Files come with ``text``; with ``content`` and ``is_binary`` as well, binary ones go to the converters.
    """
    chosen = select_files(files, spec)
    converters = converters or {}
    binary = None
    if "is_binary" in files.columns:
        binary = F.col("is_binary")
        if converters:
            given = chosen.withColumn("__bytes", F.when(binary, F.col("content")))
            done = convert_dispatch(given, converters, "__bytes", "__converted")
            has = converter_key(F.col("path"), converters).isNotNull()
            chosen = done.withColumn(
                "text", F.when(binary & has, F.col("__converted")).otherwise(F.col("text"))
            ).drop("__bytes", "__converted")
    if single_command and converters and not (spec.lines.filters or spec.lines.numbers):
        chosen = wrap_decision(chosen, converter_key(F.col("path"), converters).isNotNull())
    blocks = file_blocks(chosen, spec.lines, now, is_binary=binary)
    if not spec.instructions or build_model is None:
        return blocks
    matching = F.transform(
        instructions_for_file(F.col("path"), spec.instructions), lambda i: i["instruction"]
    )
    return apply_instructions(blocks, "out", matching, build_model)
