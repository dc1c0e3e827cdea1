"""The line search on whole texts: one row in, one row out, no shuffle, fit for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import line_hit, matches_any, may_have_hits
from ..spec import LineSpec


def split_array(text: Column) -> Column:
    """Lines of a text; a last newline yields a last empty line."""
    return F.split(text, "\n", -1)


def number_lines(text: Column) -> Column:
    shown = lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line)
    return F.array_join(F.transform(split_array(text), shown), "\n")


def hits(lines: Column, spec: LineSpec) -> Column:
    """Indexes of the lines that match."""
    return F.array_compact(
        F.transform(lines, lambda line, i: F.when(line_hit(line, spec.include, spec.remove), i))
    )


def matching_lines(lines: Column, spec: LineSpec) -> Column:
    return F.filter(lines, lambda line: line_hit(line, spec.include, spec.remove))


def with_context(hit_indexes: Column, line_count: Column, spec: LineSpec) -> Column:
    """Hit indexes and their neighbours, ascending and without repeats.

    Work grows with the number of hits. Ranges around ascending hits have one width, so the first sight of
    each index is already in order.
    """
    if not spec.has_context:
        return hit_indexes
    around = lambda i: F.sequence(
        F.greatest(i - spec.before, F.lit(0)), F.least(i + spec.after, line_count - 1), F.lit(1)
    )
    return F.array_distinct(F.flatten(F.transform(hit_indexes, around)))


def _shown(line: Column, index: Column, spec: LineSpec) -> Column:
    """A kept line as printed; null when it is left out."""
    number = F.concat((index + 1).cast("string"), F.lit(":"))
    if spec.numbers:
        full = F.concat(number, F.lit(" "), line)
        return F.when(matches_any(line, spec.remove), number).otherwise(full) if spec.remove else full
    return F.when(~matches_any(line, spec.remove), line) if spec.remove and spec.has_context else line


def gap_separator(ticks: Column) -> Column:
    return F.concat(ticks, F.lit("\n\n"), ticks)


def grep_report(
    docs: DataFrame, spec: LineSpec, text: str = "text", ticks: Column | None = None, name: str = "report"
) -> DataFrame:
    """Add the filtered, numbered and gap-marked lines of each text as one string.

    Texts without a hit get an empty string, most of them without being split. ``ticks`` is the fence that
    closes and reopens at a gap.
    """
    ticks = F.lit("```") if ticks is None else ticks
    searched = may_have_hits(F.col(text), spec.include) | F.col(text).isNull()
    lines = F.when(searched, split_array(F.col(text))).otherwise(F.expr("cast(array() as array<string>)"))
    staged = docs.withColumn("__ticks", ticks).withColumn("__lines", lines)
    if not spec.has_context:
        found = F.transform(
            F.col("__lines"),
            lambda line, i: F.when(line_hit(line, spec.include, spec.remove), _shown(line, i, spec)),
        )
        return staged.withColumn(name, F.array_join(found, "\n")).drop("__ticks", "__lines")
    staged = staged.withColumn("__hits", hits(F.col("__lines"), spec)).withColumn(
        "__kept", with_context(F.col("__hits"), F.size("__lines"), spec)
    )

    def piece(index: Column, at: Column) -> Column:
        line = F.get(F.col("__lines"), index)
        gap = (at > 0) & (index > F.get(F.col("__kept"), at - 1) + 1)
        return F.array(F.when(gap, gap_separator(F.col("__ticks"))), _shown(line, index, spec))

    pieces = F.flatten(F.transform(F.col("__kept"), piece))
    return staged.withColumn(name, F.array_join(pieces, "\n")).drop("__ticks", "__lines", "__hits", "__kept")


def shown_text(docs: DataFrame, spec: LineSpec, text: str, ticks: Column, name: str) -> DataFrame:
    """The body of a block: searched lines, numbered lines or the text itself, as the options ask."""
    if spec.filters:
        return grep_report(docs, spec, text, ticks, name)
    return docs.withColumn(name, number_lines(F.col(text)) if spec.numbers else F.col(text))
