"""Regular expressions, globs and wildcards as column predicates.

Users write patterns in the dialect of the tool this library stands in for, where ``.`` stops only at a
newline, ``$`` also matches before a last newline, classes are Unicode aware, and a brace that opens no
quantifier is a plain character. Spark evaluates Java patterns, so patterns are adapted once on the driver.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("\\.^$|?*+()[]{}")
_QUANTIFIER = re.compile(r"\{\d+(,\d*)?\}")
_QUOTED_NAME = re.compile(r"(\(\?|\\k)'([A-Za-z][A-Za-z0-9]*)'")
_PUNCTUATION = tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_WITH_OPERAND = re.compile(
    r"\\(?:[pPx]\{[^}]*\}|[pP][A-Z]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|c[A-Za-z]|k<[A-Za-z0-9]+>|k'[A-Za-z0-9]+')"
)
_PLAIN_ESCAPES = tuple("dDwWsSbBAzZ")


def is_literal(pattern: str) -> bool:
    return not any(c in _META for c in pattern)


@dataclass(frozen=True)
class _Class:
    """A character class: its items as Java writes them, and the class that is taken away from it."""

    negated: bool
    items: str
    less: _Class | None

    def java(self, inverted: bool = False) -> str:
        own = "[" + ("^" if self.negated != inverted else "") + self.items + "]"
        if self.less is None:
            return own
        return "[" + own + (self.less.java() if inverted else "&&" + self.less.java(True)) + "]"


def _escape(pattern: str, i: int) -> str:
    """The escape that starts at ``i``, with a braced operand."""
    end = i + 2
    if pattern[i + 1 : i + 2] in ("p", "P", "x", "N") and pattern.startswith("{", end):
        end = pattern.find("}", end) + 1 or end
    return pattern[i:end]


def _read_class(pattern: str, i: int) -> tuple[_Class, int]:
    """The class that starts at ``i`` and where it ends. Its last item may be a class to subtract: ``[a-z-[aeiou]]``."""
    i += 1
    negated = pattern.startswith("^", i)
    i += negated
    items, less = [], None
    if pattern.startswith("]", i):
        items, i = ["\\]"], i + 1
    while i < len(pattern) and pattern[i] != "]":
        if pattern.startswith("-[", i) and items:
            less, i = _read_class(pattern, i + 1)
            continue
        if pattern[i] == "\\":
            items.append(_escape(pattern, i))
        elif pattern[i] == "[" or pattern.startswith("&&", i):
            items.append("\\" + pattern[i])
            i += 1
            continue
        else:
            items.append(pattern[i])
        i += len(items[-1])
    return _Class(negated, "".join(items), less), i + 1


def java_pattern(pattern: str) -> str:
    """The Java spelling of a pattern, with Unix lines and Unicode classes switched on.

    Class subtraction becomes an intersection, quoted group names become bracketed ones.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        quoted = _QUOTED_NAME.match(pattern, i)
        if quoted:
            out.append(f"{quoted[1]}<{quoted[2]}>")
            i = quoted.end()
        elif c == "\\":
            out.append(_escape(pattern, i))
            i += len(out[-1])
        elif c == "[":
            found, i = _read_class(pattern, i)
            out.append(found.java())
        elif c == "{":
            quantifier = _QUANTIFIER.match(pattern, i) if out else None
            out.append(quantifier.group() if quantifier else "\\{")
            i += len(quantifier.group()) if quantifier else 1
        else:
            out.append(c)
            i += 1
    return "(?dU)" + "".join(out)


def required_text(pattern: str) -> str | None:
    """The longest plain text that every match of the pattern contains, if two characters of it are certain.

    Groups, classes and optional characters promise nothing, nor do escapes with what belongs to them. Alternatives,
    inline flags and all escapes that are not known here make it give up, as an escape may take what follows it.
    """
    if is_literal(pattern):
        return pattern
    if re.search(r"\(\?[a-zA-Z\-]+[:)]|\(\?#", pattern):
        return None
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, step = pattern[i], 1
        if c == "\\":
            operand = _WITH_OPERAND.match(pattern, i)
            step = operand.end() - i if operand else 2
            c = pattern[i + 1 : i + 2]
            plain = c in _PUNCTUATION
            if not (operand or plain or c in _PLAIN_ESCAPES):
                return None
        elif c == "[":
            step, plain = _read_class(pattern, i)[1] - i, False
        elif c == "{":
            step, plain = max(pattern.find("}", i) + 1 - i, 1), False
        else:
            if c == "|":
                return None
            depth += (c == "(") - (c == ")")
            plain = c not in _META
        after = pattern[i + step : i + step + 1]
        if plain and depth == 0 and after not in ("*", "?", "{"):
            run += c
            closed = after == "+"
        else:
            closed = True
        if closed:
            runs, run = [*runs, run], ""
        i += step
    longest = max([*runs, run], key=len)
    return longest if len(longest) > 1 else None


def matches(text: Column, pattern: str) -> Column:
    """True where the pattern occurs in the text.

    Plain text takes the byte search alone; a pattern that cannot do without some plain text takes it first,
    so the regex engine sees few rows.
    """
    if is_literal(pattern):
        return text.contains(F.lit(pattern))
    found = text.rlike(java_pattern(pattern))
    required = required_text(pattern)
    return found if required is None else text.contains(F.lit(required)) & found


def may_have_hits(text: Column, include: Iterable[str]) -> Column:
    """False only for texts that cannot hold a line with every pattern; far cheaper than splitting lines."""
    needed = (required_text(p) for p in include)
    return reduce(lambda a, b: a & b, (text.contains(F.lit(t)) for t in needed if t), F.lit(True))


def matches_all(text: Column, patterns: Iterable[str]) -> Column:
    """Conjunction; an empty list accepts everything."""
    return reduce(lambda a, b: a & b, (matches(text, p) for p in patterns), F.lit(True))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Disjunction; an empty list accepts nothing."""
    return reduce(lambda a, b: a | b, (matches(text, p) for p in patterns), F.lit(False))


def line_hit(line: Column, include: Iterable[str], remove: Iterable[str]) -> Column:
    include, remove = tuple(include), tuple(remove)
    if include and remove:
        return matches_all(line, include) & ~matches_any(line, remove)
    if remove:
        return ~matches_any(line, remove)
    return matches_all(line, include)


def glob_regex(glob: str, ignore_case: bool = True) -> str:
    """An anchored pattern for a file glob over relative paths.

    ``*`` and ``?`` stay within a path segment, ``**`` spans any number of segments, ``**.ext`` means
    ``**/*.ext`` and a trailing slash means everything below.
    """
    glob = glob.replace("\\", "/")
    below = glob.endswith("/")
    segments = [s for s in posixpath.normpath(glob).split("/") if s not in ("", ".")]
    if below:
        segments.append("**")
    spread = []
    for segment in segments:
        if segment.startswith("**.") and len(segment) > 3:
            spread += ["**", segment[1:]]
        elif segment == "**" and spread and spread[-1] == "**":
            continue
        else:
            spread.append(segment)
    out = []
    for i, segment in enumerate(spread):
        last = i == len(spread) - 1
        if segment == "**":
            out.append(".*" if last else "(?:[^/]*/)*")
        else:
            segment = "*" if segment == "*.*" else segment
            chars = {"*": "[^/]*", "?": "[^/]"}
            out.append("".join(chars.get(c, re.escape(c)) for c in segment) + ("" if last else "/"))
    return ("(?i)" if ignore_case else "") + "^" + "".join(out) + r"\z"


def glob_match(path: Column, glob: str, ignore_case: bool = True) -> Column:
    """A path test for a glob; "everything" and "any file with this ending" need no regex."""
    if glob in ("**", "**/*"):
        return path.isNotNull()
    ending = glob.removeprefix("**/*")
    if glob != ending and ending.isascii() and not set(ending) & set("*?/\\") and ending != ".":
        return F.lower(path).endswith(F.lit(ending.lower())) if ignore_case else path.endswith(F.lit(ending))
    return path.rlike("(?s)" + glob_regex(glob, ignore_case))


def any_glob(path: Column, globs: Iterable[str], ignore_case: bool = True) -> Column:
    return reduce(lambda a, b: a | b, (glob_match(path, g, ignore_case) for g in globs), F.lit(False))


def wildcard_regex(wildcard: str) -> str:
    """A name wildcard as an anchored pattern; other regex characters keep their meaning."""
    return "^" + wildcard.replace(".", "\\.").replace("*", ".*").replace("?", ".") + "$"


def split_exclusions(rules: Iterable[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Separate rules with a slash (globs) from those without (names)."""
    rules = tuple(rules)
    slashed = tuple(r for r in rules if "/" in r or "\\" in r)
    return slashed, tuple(r for r in rules if r not in slashed)


def ignore_exclusions(lines: Iterable[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Lines of an ignore file as globs and unanchored name patterns; blank lines are skipped."""
    return split_exclusions(line for line in lines if line.strip())
