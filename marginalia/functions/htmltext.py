"""Text, titles and links out of HTML, all as JVM-side string expressions."""

from __future__ import annotations

import json
import zlib
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_ATTRS = r"""[^'">]*+(?:"[^"]*+"[^'">]*+|'[^']*+'[^'">]*+)*+"""
# A tag name ends before white space, a slash or the end of the tag; \b would also stop at a hyphen.
_END = r"(?=[\s/>])"
_SCRIPT = rf"script{_END}{_ATTRS}>(.*?)</script\s*+>|style{_END}{_ATTRS}>(.*?)</style\s*+>"
_COMMENT = r"!--.*?(?:-->|\z)"
_TAG = rf"[!?][^>]*+>|/?[A-Za-z]{_ATTRS}>"
_MARKUP = rf"(?is)<(?:{_SCRIPT}|{_COMMENT}|{_TAG})"
_HIDDEN = rf"(?is)<(?:{_SCRIPT}|{_COMMENT})"
_DRAWING = rf"(?is)<svg{_END}{_ATTRS}>.*?</svg\s*+>"
# Attributes up to, but not with, an href of the tag itself.
_ATTRIBUTE = r"""[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+"""
_BEFORE_HREF = rf"""(?:[\s/]++(?!href[\s=]){_ATTRIBUTE})*+[\s/]++"""
_BLANKS = " \\t\\x0B\\f\\u00A0\\u200B"


def inner_text(html: Column, drop_script: bool = True) -> Column:
    """The text between tags, entities still encoded. Scripts and styles go or stay as raw text."""
    return F.regexp_replace(html, _MARKUP, "" if drop_script else "$1$2")


def decode_core_entities(text: Column) -> Column:
    """The five core entities and the hard space, the ampersand last so nothing is decoded twice."""
    core = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"))
    for name, char in (*core, ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _entity_char(entity: Column) -> Column:
    """The character of an entity given without ``&`` and ``;``; null when there is none."""
    named = {**{name: chr(point) for name, point in name2codepoint.items()}, "apos": "'"}
    table = F.create_map(*(F.lit(x) for pair in sorted(named.items()) for x in pair))
    digits = F.regexp_replace(entity, "^#[xX]?0*(?=.)", "")
    short = F.length(digits) <= 8
    point = F.when(short & entity.rlike("^#[xX][0-9A-Fa-f]+$"), F.conv(digits, 16, 10).cast("bigint")).when(
        short & entity.rlike("^#[0-9]+$"), digits.try_cast("bigint")
    )
    valid = (point < 0xD800) | ((point > 0xDFFF) & (point <= 0x10FFFF))
    numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    return F.when(entity.startswith("#"), numeric).otherwise(F.try_element_at(table, entity))


def decode_entities(text: Column) -> Column:
    """Every named and numeric entity in one pass; unknown ones stay as they are."""
    mark = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
    inside = lambda e: F.substring(e, F.lit(2), F.length(e) - 2)

    def decoded(bound: Column) -> Column:
        found = F.regexp_extract_all(bound, F.lit(mark), F.lit(0))
        chars = F.transform(found, lambda e: F.coalesce(_entity_char(inside(e)), e))
        pairs = F.zip_with(F.split(bound, mark, -1), F.concat(chars, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(bound.contains("&"), F.array_join(pairs, "")).otherwise(bound)

    return let(text, decoded)


_BUCKETS = 64
# What HTML takes for a reference: a number, or up to 32 characters; the semicolon may be missing.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _listed(entries: dict[str, str]) -> Column:
    """A constant map, given as one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string, string>")


def _html5_name(name: Column) -> Column:
    """The characters for a name without ``&``; what follows the longest known start of it stays. Null for none.

    Names with their semicolon are looked up in one of 64 maps by checksum. A start of a name never holds a semicolon, so
    it is one of the few names that HTML knows without one; an alternation, longest first, finds it.
    """
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for known, chars in html5.items():
        buckets[zlib.crc32(known.encode()) % _BUCKETS][known] = chars
    maps = F.from_json(F.lit(json.dumps(buckets)), "array<map<string, string>>")
    whole = F.try_element_at(F.get(maps, (F.crc32(name.cast("binary")) % _BUCKETS).cast("int")), name)
    open_ended = {known: chars for known, chars in html5.items() if not known.endswith(";")}
    longest = "^(?:" + "|".join(sorted(open_ended, key=len, reverse=True)) + ")"
    start = F.regexp_extract(name, longest, 0)
    known = F.concat(F.try_element_at(_listed(open_ended), start), F.substring(name, F.length(start) + 1, F.length(name)))
    return F.coalesce(whole, F.when(start != "", known))


def _html5_number(number: Column) -> Column:
    """The character for ``#65;`` or ``#x41``: 128 to 159 as in Windows-1252, none for what is no character."""
    digits = F.regexp_replace(number, "^#[xX]?0*(?=[0-9a-fA-F])|;$", "")
    hexadecimal = number.rlike("^#[xX]")
    point = F.when(F.length(digits) > 8, F.lit(1 << 40)).when(hexadecimal, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))
    low = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    replaced = (point == 0) | ((point >= 0xD800) & (point <= 0xDFFF)) | (point > 0x10FFFF)
    control = ((point < 0x20) & ~point.isin(9, 10, 12, 13)) | (point == 0x7F)
    no_character = control | ((point >= 0xFDD0) & (point <= 0xFDEF)) | (point.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    coded = F.when((point >= 0x80) & (point < 0xA0), F.try_element_at(_listed(low), point.cast("string")))
    return F.when(replaced, F.lit("\ufffd")).otherwise(F.coalesce(coded, F.when(no_character, F.lit("")).otherwise(char)))


def decode_html5(text: Column) -> Column:
    """All references of HTML5, as browsers read them: 2,125 names, some of them without semicolon, and any number.

    ``decode_entities`` is narrower: it wants the semicolon and leaves what names no character.
    """

    def decoded(bound: Column) -> Column:
        found = F.regexp_extract_all(bound, F.lit(_REFERENCE), F.lit(0))
        inside = lambda e: F.substring(e, F.lit(2), F.length(e))
        char = lambda e: F.when(e.startswith("&#"), _html5_number(inside(e))).otherwise(F.coalesce(_html5_name(inside(e)), e))
        chars = F.transform(found, char)
        pairs = F.zip_with(F.split(bound, _REFERENCE, -1), F.concat(chars, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(bound.contains("&"), F.array_join(pairs, "")).otherwise(bound)

    return let(text, decoded)


def collapse_blanks(text: Column) -> Column:
    """Drop empty lines, squeeze runs of white lines to one empty line, drop white lines at the end."""
    lines = F.replace(text, F.lit("\r"), F.lit("\n"))
    lines = F.btrim(F.regexp_replace(lines, "\n\n+", "\n"), F.lit("\n"))
    white = rf"\n[{_BLANKS}]++(?=\n|\z)(?:\n[{_BLANKS}]++(?=\n|\z))*+"
    squeezed = F.regexp_replace(F.concat(F.lit("\n"), lines), white, "\n")
    return F.rtrim(F.substring(squeezed, 2, 2147483647), F.lit("\n"))


def strip_html(html: Column, drop_script: bool = True) -> Column:
    """A readable text of a page."""
    return let(inner_text(html, drop_script), lambda text: collapse_blanks(decode_entities(text)))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[ \t\n\f\r]+", " "), F.lit(" "))


def page_title(html: Column) -> Column:
    """The first title outside comments, scripts and drawings."""
    visible = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _DRAWING, "")
    return squeeze(decode_entities(F.regexp_extract(visible, rf"(?is)<title{_END}{_ATTRS}>(.*?)</title\s*+>", 1)))


def page_links(html: Column) -> Column:
    """The ``href`` of every anchor in page order, as written there; none from comments or scripts."""
    visible = F.regexp_replace(html, _HIDDEN, "")
    value = r"""href\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']+)"""
    raw = F.regexp_extract_all(visible, F.lit(rf"(?is)<a(?=[\s/]){_BEFORE_HREF}{value}"), F.lit(1))
    return F.transform(raw, lambda v: decode_entities(F.regexp_replace(v, r"""(?s)^["'](.*)["']\z""", "$1")))


def rate_limit_seconds(content: Column) -> Column:
    """Seconds to wait when a fetched page is a rate-limit notice, else null."""
    after = F.substring(content, F.instr(content, "Try again in ") + len("Try again in "), 2147483647)
    seconds = F.trim(F.substring_index(after, " seconds.", 1)).try_cast("int")
    return F.when(content.contains("Rate limit is exceeded. Try again in"), seconds)
