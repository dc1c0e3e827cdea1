"""Markdown pieces: fences, tags, sizes, ages, blocks, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension

# Fence language by file extension.
LANGUAGES = {
    ".bat": "batch",
    ".bmp": "markdown",
    ".cpp": "cpp",
    ".cs": "csharp",
    ".csproj": "xml",
    ".css": "css",
    ".docx": "markdown",
    ".gif": "markdown",
    ".go": "go",
    ".html": "html",
    ".java": "java",
    ".jpeg": "markdown",
    ".jpg": "markdown",
    ".js": "javascript",
    ".json": "json",
    ".kt": "kotlin",
    ".m": "objective-c",
    ".md": "markdown",
    ".pdf": "markdown",
    ".php": "php",
    ".pl": "perl",
    ".png": "markdown",
    ".pptx": "markdown",
    ".py": "python",
    ".r": "r",
    ".rb": "ruby",
    ".rs": "rust",
    ".scala": "scala",
    ".sh": "bash",
    ".sln": "xml",
    ".sql": "sql",
    ".swift": "swift",
    ".ts": "typescript",
    ".xml": "xml",
    ".yaml": "yaml",
    ".yml": "yaml",
}
DEFAULT_LANGUAGE = "plaintext"

STDIN = "-"
PLAIN_FENCE = "```"


# Every Unicode white space character, and the same as a regex. The look-ahead settles almost every character
# by one table lookup before the long class is tried.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE_RUN = r"(?=[\t-\r \x85\xA0]|[^\x00-\xFF])([\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]++)"


def trim_end(text: Column) -> Column:
    """Without trailing white space of any kind."""
    return F.rtrim(text, F.lit(WHITE_SPACE))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return trim_start(text) == ""


def fence_len(text: Column) -> Column:
    """One more than the longest backtick run, at least three."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    longest = F.when(text.contains("```"), F.array_max(runs)).otherwise(F.lit(0))
    return F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1)


def fence(text: Column, extra: int = 0) -> Column:
    return F.repeat(F.lit("`"), fence_len(text) + extra)


def fence_choice(path: Column, text: Column, is_binary: Column | None = None) -> Column:
    """A fitted fence for markdown, unnamed and converted content, three ticks for all else."""
    fitted = (path == STDIN) | F.lower(path).endswith(".md")
    if is_binary is not None:
        fitted = fitted | is_binary
    return F.when(fitted, fence(text)).otherwise(F.lit(PLAIN_FENCE))


def lang_tag(path: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit(DEFAULT_LANGUAGE))


def friendly_size(length: Column) -> Column:
    steps = ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB"))
    out = None
    for unit, name in steps:
        shown = F.concat(F.call_function("div", length, F.lit(unit)).cast("string"), F.lit(f" {name}"))
        out = F.when(length >= unit, shown) if out is None else out.when(length >= unit, shown)
    return out.otherwise(F.concat(length.cast("string"), F.lit(" bytes")))


def friendly_age(modified: Column, now: Column) -> Column:
    """How long ago, in words; older than a week shows the time itself. ``now`` is an argument by design."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(modified)
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(minutes == 1, F.lit("1 minute ago"))
        .when(minutes < 60, said(minutes, "minutes"))
        .when(hours == 1, F.lit("1 hour ago"))
        .when(hours < 24, said(hours, "hours"))
        .when(days == 1, F.lit("1 day ago"))
        .when(days < 7, said(days, "days"))
        .otherwise(F.date_format(modified, "MM/dd/yyyy HH:mm:ss"))
    )


def unnamed_block(body: Column, ticks: Column) -> Column:
    return F.concat(F.lit("## (stdin)\n\n"), ticks, F.lit("\n"), body, F.lit("\n"), ticks, F.lit("\n"))


def file_block(path: Column, modified: Column, size: Column, body: Column, ticks: Column) -> Column:
    """Heading, friendly facts and the fenced body; content without a name gets the short form."""
    named = F.concat(
        F.lit("## "), path, F.lit("\n\nModified: "), modified, F.lit("\nSize: "), size, F.lit("\n\n"),
        ticks, lang_tag(path), F.lit("\n"), body, F.lit("\n"), ticks, F.lit("\n"),
    )
    return F.when(path == STDIN, unnamed_block(body, ticks)).otherwise(named)


def file_error_block(path: Column, message: Column, trace: Column) -> Column:
    return F.concat(F.lit("## "), path, F.lit(" - Error reading file: "), message, F.lit("\n\n"), trace)


def page_error_block(url: Column, message: Column, trace: Column) -> Column:
    return F.concat(F.lit("## Error fetching "), url, F.lit("\n\n"), message, F.lit("\n"), trace)


def page_block(title: Column, url: Column, body: Column) -> Column:
    return F.concat(
        F.lit("## "), title, F.lit("\n\nurl: "), url, F.lit("\n\n```\n"), body, F.lit("\n```\n\n")
    )


def run_block(script: Column, output: Column, exit_code: Column) -> Column:
    """A recorded command: what ran (when it is more than a line), what it printed, how it failed."""
    ticks = fence(output)
    multi = script.contains("\n")
    head = F.when(multi, F.lit("## Run\n\n")).otherwise(F.concat(F.lit("## `"), script, F.lit("`\n\n")))
    fenced = lambda label, text: F.concat(
        F.lit(label + ":\n"), ticks, F.lit("\n"), trim_end(text), F.lit("\n"), ticks, F.lit("\n\n")
    )
    code = F.concat(F.lit("Exit code: "), exit_code.cast("string"), F.lit("\n\n"))
    none = F.lit("")
    whole = F.concat(
        head,
        F.when(multi, fenced("Run", script)).otherwise(none),
        fenced("Output", output),
        F.when(exit_code != 0, code).otherwise(none),
    )
    return trim_end(whole)


def run_error_block(script: Column, message: Column, trace: Column) -> Column:
    return F.concat(F.lit("## Error executing command: "), script, F.lit("\n\n"), message, F.lit("\n"), trace)


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_rule(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda _: F.lit("---")), "|"), F.lit("|"))


def cell_text(paragraphs: Column) -> Column:
    """Paragraphs of a table cell on one line, blank ones left out."""
    kept = F.filter(F.transform(paragraphs, trim_end), lambda p: ~is_blank(p))
    return trim_end(trim_start(F.array_join(kept, "<br/>")))


def markdown_link(text: Column, uri: Column) -> Column:
    """A link; empty when the target is unknown."""
    return F.coalesce(F.concat(F.lit("["), text, F.lit("]("), uri, F.lit(")")), F.lit(""))
