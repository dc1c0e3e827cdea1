"""Choose files by path and content."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..functions.patterns import (
    any_glob,
    glob_match,
    ignore_exclusions,
    matches_all,
    matches_any,
    split_exclusions,
    wildcard_regex,
)
from ..sources.files import text_decode
from ..spec import FileSpec


def first_glob(path: Column, globs: Sequence[str]) -> Column:
    """Ordinal of the first glob that takes the path; null when none does."""
    return F.coalesce(*(F.when(glob_match(path, g), F.lit(i)) for i, g in enumerate(globs)))


def glob_union_distinct(files: DataFrame, globs: Sequence[str]) -> DataFrame:
    """Paths of several globs in glob order, each once, with the ordinal of the first glob that took it."""
    return (
        files.select("path", first_glob(F.col("path"), globs).alias("glob_ord"))
        .filter(F.col("glob_ord").isNotNull())
        .distinct()
    )


def name_excluded(path: Column, wildcards: Iterable[str]) -> Column:
    return matches_any(base_name(path), [wildcard_regex(w) for w in wildcards])


def exclude_names(files: DataFrame, wildcards: Iterable[str]) -> DataFrame:
    return files.filter(~name_excluded(F.col("path"), wildcards))


def exclude_globs(files: DataFrame, globs: Iterable[str]) -> DataFrame:
    """Files that no exclude glob takes. Globs are options, so a predicate does the anti join's work."""
    return files.filter(~any_glob(F.col("path"), globs))


def exclude_paths(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files whose path is not in a table of paths, for exclusion lists that are data."""
    return files.join(excluded.select("path"), "path", "left_anti")


def exclude(files: DataFrame, rules: Iterable[str]) -> DataFrame:
    """Rules with a slash are globs, others are wildcards on the name."""
    globs, names = split_exclusions(rules)
    return exclude_names(exclude_globs(files, globs), names)


def ignored(path: Column, lines: Iterable[str]) -> Column:
    globs, names = ignore_exclusions(lines)
    return any_glob(path, globs) | matches_any(base_name(path), names)


def ignore_rules(files: DataFrame, lines: Iterable[str]) -> DataFrame:
    """Drop files named by the lines of an ignore file."""
    return files.filter(~ignored(F.col("path"), lines))


def content_passes(text: Column, contains: Iterable[str], not_contains: Iterable[str]) -> Column:
    """Content test; content that could not be read fails any test there is."""
    contains, not_contains = tuple(contains), tuple(not_contains)
    if not contains and not not_contains:
        return F.lit(True)
    passes = matches_all(text, contains)
    if not_contains:
        passes = passes & ~matches_any(text, not_contains)
    return text.isNotNull() & F.coalesce(passes, F.lit(False))


def file_contains_all(files: DataFrame, patterns: Iterable[str], text: str = "text") -> DataFrame:
    return files.filter(content_passes(F.col(text), patterns, ()))


def file_not_contains_any(files: DataFrame, patterns: Iterable[str], text: str = "text") -> DataFrame:
    return files.filter(content_passes(F.col(text), (), patterns))


def path_selected(path: Column, spec: FileSpec) -> Column:
    globs, names = split_exclusions(spec.exclude)
    wanted = any_glob(path, spec.globs or ("**",))
    return wanted & ~any_glob(path, globs) & ~name_excluded(path, names) & ~ignored(path, spec.ignore_lines)


def tested_text(files: DataFrame, text: str = "text") -> Column:
    """What content tests read: the text, or the bytes of a binary file as UTF-8. Null is unreadable content."""
    if "content" not in files.columns:
        return F.col(text)
    return F.coalesce(F.col(text), text_decode(F.col("content")))


def select_files(files: DataFrame, spec: FileSpec, text: str = "text") -> DataFrame:
    """Path tests first, content tests on what is left."""
    named = files.filter(path_selected(F.col("path"), spec))
    return named.filter(content_passes(tested_text(files, text), spec.contains, spec.not_contains))


def no_match_notice(files: DataFrame, requests: Sequence[FileSpec], text: str = "text") -> DataFrame:
    """Per request, a notice when no file was found or none passed the content test, else null.

    All requests are counted in one pass; only the counts are shuffled.
    """
    path, counts = F.col("path"), []
    for i, spec in enumerate(requests):
        named = path_selected(path, spec)
        passed = named & content_passes(tested_text(files, text), spec.contains, spec.not_contains)
        counts += [F.count_if(named).alias(f"found_{i}"), F.count_if(passed).alias(f"passed_{i}")]

    def notice(i: int, spec: FileSpec) -> Column:
        head = "## Pattern: " + " ".join(spec.globs) + "\n\n"
        text = F.when(F.col(f"found_{i}") == 0, F.lit(head + " - No files found\n")).when(
            F.col(f"passed_{i}") == 0, F.lit(head + " - No files matched criteria\n")
        )
        return F.struct(
            F.lit(i).alias("request"),
            F.col(f"found_{i}").alias("found"),
            F.col(f"passed_{i}").alias("passed"),
            text.alias("notice"),
        )

    rows = F.array(*(notice(i, spec) for i, spec in enumerate(requests)))
    return files.agg(*counts).select(F.inline(rows))


def wrap_decision(files: DataFrame, convertible: Column, single_command: bool = True) -> DataFrame:
    """Add ``wrap``: false only for the one convertible file of a single command.

    Whether there is a second file is a scalar subquery that stops at two rows per task, not a window over
    all files.
    """
    if not single_command:
        return files.withColumn("wrap", F.lit(True))
    total = files.select(F.lit(1).alias("one")).limit(2).agg(F.count("one").alias("n")).scalar()
    return files.withColumn("wrap", ~((total == 1) & F.coalesce(convertible, F.lit(False))))


def keyword_find(items: DataFrame, term: str, name: str, body: str) -> DataFrame:
    """Items with the term in name or body, any case, fewer spaces in the name first, then by name."""
    wanted = F.lit(term.lower())
    found = F.lower(F.col(name)).contains(wanted) | F.lower(F.col(body)).contains(wanted)
    spaces = F.length(name) - F.length(F.replace(F.col(name), F.lit(" "), F.lit("")))
    return items.filter(found).withColumn("spaces", spaces).orderBy("spaces", name)
