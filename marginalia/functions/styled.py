"""Styled text to markdown, for paragraphs held as an array of elements.

An element is ``struct(kind, bold, italic, text, uri)`` with kind ``run``, ``break`` or ``link``. The
functions work inside one row; ``operators.styled`` has the form for tables with one row per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .markdown import WHITE_RUN, WHITE_SPACE, is_blank, markdown_link, trim_end, trim_start

# Two code points that Unicode sets aside for internal use hold the place of closing marks.
_ITALIC_OFF = "\ufdd0"
_BOLD_OFF = "\ufdd1"
_CLOSING = f"[{_ITALIC_OFF}{_BOLD_OFF}]"

# What bold and italic can be, and for each two such states, of a run and the one after it, the marks between them.
_STATES = [(bold, italic) for italic in (False, True, None) for bold in (False, True, None)]
_BETWEEN = [
    (
        _ITALIC_OFF * (was[1] is True and now[1] is False) + _BOLD_OFF * (was[0] is True and now[0] is False),
        "**" * (now[0] is True and was[0] is not True) + "_" * (now[1] is True and was[1] is not True),
    )
    for was in _STATES
    for now in _STATES
]

HEADING = r"(?i)^heading\s*\+?(\d+)\s*\z"


def heading_level(style: Column) -> Column:
    """Level of a ``HeadingN`` style, at most six; zero for other styles."""
    level = F.regexp_extract(style, HEADING, 1).try_cast("int")
    return F.least(F.coalesce(level, F.lit(0)), F.lit(6))


def list_mark(kind: Column) -> Column:
    return F.when(kind == "bullet", "- ").when(kind == "numbered", "1. ").otherwise("")


def paragraph_prefix(style: Column, list_kind: Column) -> Column:
    """Heading marks, then the list mark."""
    level = heading_level(style)
    heading = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).otherwise("")
    return F.concat(heading, list_mark(list_kind))


def marked_run(
    run: Column, last: Column, wrap: Callable[[Column], Column] = lambda text: text
) -> tuple[Column, Column]:
    """Place holders of the marks that close before a run, and its text with the marks it opens.

    ``last`` is the run before it that has text. White space at the start of a run stays outside its marks.
    """
    was = lambda field: F.coalesce(last[field], F.lit(False))
    mark = lambda cond, text: F.when(cond, F.lit(text)).otherwise("")
    opens = F.concat(
        mark(run["bold"] & ~was("bold"), "**"), mark(run["italic"] & ~was("italic"), "_")
    )
    turns_on = (run["bold"] & ~was("bold")) | (run["italic"] & ~was("italic"))
    closes = closing_marks(~run["bold"] & was("bold"), ~run["italic"] & was("italic"))
    body = run["text"]
    core = trim_start(body)
    lead = F.left(body, F.length(body) - F.length(core))
    opened = F.when(turns_on, F.concat(lead, opens, wrap(core))).otherwise(wrap(body))
    return closes, opened


def piece(closes: Column, text: Column) -> tuple[Column, Column, Column]:
    """A piece of a paragraph: marks to close before it, its text, and the white space at the text's end."""
    head = trim_end(text)
    return closes.alias("closes"), head.alias("head"), F.right(text, F.length(text) - F.length(head)).alias("trail")


def closing_marks(bold: Column, italic: Column) -> Column:
    """Place holders of closing marks, italic first."""
    return F.concat(F.when(italic, _ITALIC_OFF).otherwise(""), F.when(bold, _BOLD_OFF).otherwise(""))


def close_marks(text: Column) -> Column:
    """Move closing marks in front of the white space before them, then write them out.

    Bold and italic can close at different places within one stretch of white space, hence two passes.
    """
    ahead = f"{WHITE_RUN}({_CLOSING}+)"
    moved = F.regexp_replace(F.regexp_replace(text, ahead, "$2$1"), ahead, "$2$1")
    return _written(moved)


def _written(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ITALIC_OFF), F.lit("_")), F.lit(_BOLD_OFF), F.lit("**"))


def join_pieces(pieces: Column, final: Column) -> Column:
    """Pieces in order as one text, ``final`` closing what is still open.

    Marks close before the white space at the end of the piece before. A piece of nothing but white space
    does not bound that white space; a paragraph with such a piece takes the general way.
    """

    def closed(p: Column, i: Column) -> Column:
        return F.concat(p["head"], F.coalesce(F.get(pieces, i + 1)["closes"], final), p["trail"])

    direct = _written(F.array_join(F.transform(pieces, closed), ""))
    whole = F.transform(pieces, lambda p: F.concat(p["closes"], p["head"], p["trail"]))
    general = close_marks(F.concat(F.array_join(whole, ""), final))
    return F.when(F.exists(pieces, lambda p: p["head"] == ""), general).otherwise(direct)


def run_state(bold: Column, italic: Column) -> Column:
    """The place of a run's bold and italic in ``_STATES``."""
    part = lambda c: F.when(c.isNull(), 2).otherwise(c.cast("int"))
    return part(bold) + 3 * part(italic)


def has_mark(state: Column) -> Column:
    return state.isin([place for place, marks in enumerate(_STATES) if True in marks])


def marked_text(elements: Column) -> Column:
    """A paragraph with its marks, from sorted elements ``struct(k, text, state)``; a link's ``state`` is null.

    Each text is split once, and the marks before a run are looked up by its state and the one before. The pieces are
    sorted again, as elements may share their ``k``.
    """
    between = F.array(*(F.struct(F.lit(c).alias("closes"), F.lit(o).alias("opens")) for c, o in _BETWEEN))

    def split(e: Column, place: Column) -> Column:
        marks = F.get(between, place)
        return F.struct(e["k"].alias("k"), e["text"].alias("text"), trim_end(e["text"]).alias("head"), marks.alias("marks"))

    def marked(p: Column) -> Column:
        text, head, opens = p["text"], p["head"], p["marks"]["opens"]
        core = trim_start(head)
        after_blanks = F.concat(F.left(head, F.length(head) - F.length(core)), opens, core)
        bare = opens == ""
        opened = F.when(bare, head).when(head == "", F.concat(text, opens)).otherwise(after_blanks)
        trail = F.when(bare | (head != ""), F.substring(text, F.length(head) + 1, F.length(text))).otherwise("")
        return F.struct(p["k"].alias("k"), p["marks"]["closes"].alias("closes"), opened.alias("head"), trail.alias("trail"))

    def joined(runs: Column) -> Column:
        before = lambda i: F.coalesce(F.get(runs, i - 1)["state"], F.lit(0))
        split_runs = F.transform(runs, lambda e, i: split(e, before(i) * len(_STATES) + e["state"]))
        links = F.transform(F.filter(elements, lambda e: e["state"].isNull()), lambda e: split(e, F.lit(0)))
        last = F.get(runs, F.size(runs) - 1)
        final = F.when(last["k"].isNotNull(), F.get(between, last["state"] * len(_STATES))["closes"])
        pieces = F.sort_array(F.transform(F.concat(split_runs, links), marked))
        return let(pieces, lambda bound: join_pieces(bound, F.coalesce(final, F.lit(""))))

    return let(F.filter(elements, lambda e: e["state"].isNotNull()), joined)


def has_odd_blanks(text: Column) -> Column:
    """Whether a text is blank, or has white space other than spaces at its start or end."""
    bare = F.trim(text)
    return (bare == "") | F.left(bare, F.lit(1)).isin(*WHITE_SPACE) | F.right(bare, F.lit(1)).isin(*WHITE_SPACE)


def marked_runs(elements: Column) -> Column:
    """What ``marked_text`` gives where all elements are runs, no ``k`` is null or comes twice and none ``has_odd_blanks``.

    Each run then takes the marks between its neighbours and itself where it stands, inside of its spaces.
    """
    opens, closes = (F.array(*(F.lit(marks[i]) for marks in _BETWEEN)) for i in (1, 0))

    def marked(e: Column, i: Column) -> Column:
        text, state = e["text"], e["state"]
        before, after = (F.coalesce(F.get(elements, at)["state"], F.lit(0)) for at in (i - 1, i + 1))
        spaces = lambda bare: F.repeat(F.lit(" "), F.octet_length(text) - F.octet_length(bare))
        opened = F.concat(spaces(F.ltrim(text)), F.get(opens, before * len(_STATES) + state), F.trim(text))
        return F.concat(opened, F.get(closes, state * len(_STATES) + after), spaces(F.rtrim(text)))

    return _written(F.array_join(F.transform(elements, marked), ""))


def styled_text(elements: Column, break_text: str = "\n", linked_runs: bool = False) -> Column:
    """One line of markdown from styled elements.

    Empty runs change nothing. A break shows before the next run; a break with no run after it is dropped.
    Links stand between runs and leave the styling alone; with ``linked_runs`` a run itself carries a
    ``uri`` and is wrapped where it stands.
    """

    def either(bound: Column) -> Column:
        styled = F.exists(bound, lambda e: e["bold"] | e["italic"])
        return F.when(styled, _styled(bound, break_text, linked_runs)).otherwise(
            _unstyled(bound, break_text, linked_runs)
        )

    return let(elements, either)


def _wrapped(run: Column, text: Column, linked_runs: bool) -> Column:
    if not linked_runs:
        return text
    return F.when(run["linked"], markdown_link(text, run["uri"])).otherwise(text)


def _unstyled(elements: Column, break_text: str, linked_runs: bool) -> Column:
    """Elements without bold or italic need no marks, only breaks and links."""

    def shown(e: Column, i: Column) -> Column:
        text = F.when(e["text"] == "", "").otherwise(_wrapped(e, e["text"], linked_runs))
        if linked_runs:
            broken = F.get(elements, i - 1)["kind"] == "break"
            return F.when(e["kind"] == "run", F.when(broken, F.concat(F.lit(break_text), text)).otherwise(text))
        return F.when(e["kind"] == "run", text).when(e["kind"] == "link", markdown_link(e["text"], e["uri"]))

    return F.array_join(F.transform(elements, shown), "")


def _styled(elements: Column, break_text: str, linked_runs: bool) -> Column:
    is_run = lambda e: e["kind"] == "run"
    indexed = F.transform(elements, lambda e, i: F.struct(i.alias("at"), e.alias("e")))
    none = F.lit("")
    placed = lambda at, sub, closes, text: F.struct(at.alias("at"), F.lit(sub).alias("sub"), *piece(closes, text))

    if linked_runs:
        after_break = lambda x: is_run(x["e"]) & (F.get(elements, x["at"] - 1)["kind"] == "break")
        others = F.transform(F.filter(indexed, after_break), lambda x: placed(x["at"], 0, none, F.lit(break_text)))
    else:
        links = F.filter(indexed, lambda x: x["e"]["kind"] == "link")
        others = F.transform(
            links, lambda x: placed(x["at"], 1, none, markdown_link(x["e"]["text"], x["e"]["uri"]))
        )

    def joined(runs: Column) -> Column:
        def marked(x: Column, i: Column) -> Column:
            run = x["e"]
            last = F.get(runs, i - 1)["e"]
            return placed(x["at"], 1, *marked_run(run, last, lambda text: _wrapped(run, text, linked_runs)))

        last = F.get(runs, F.size(runs) - 1)["e"]
        final = closing_marks(last["bold"], last["italic"])
        ordered = F.sort_array(F.concat(F.transform(runs, marked), others))
        return let(ordered, lambda pieces: join_pieces(pieces, final))

    return let(F.filter(indexed, lambda x: is_run(x["e"]) & (x["e"]["text"] != "")), joined)


def document_paragraph(text: Column, style: Column, list_kind: Column) -> Column:
    """A document paragraph: prefix, styled text, and an empty line after it unless it is a list item."""
    gap = F.when(list_kind.isin("bullet", "numbered"), "").otherwise("\n")
    return F.concat(paragraph_prefix(style, list_kind), text, gap)


def slide_paragraph(elements: Column, list_kind: Column, break_text: str = "\n") -> Column:
    """A slide paragraph: trimmed at the end, without a prefix when it is empty."""
    text = trim_end(styled_text(elements, break_text, linked_runs=True))
    return let(text, lambda t: F.when(t != "", F.concat(list_mark(list_kind), t)).otherwise(""))


def shape_text(paragraphs: Column) -> Column:
    """Paragraphs of a text shape, empty ones left out."""
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")


def slide_text(number: Column, title: Column, texts: Column, tables: Column) -> Column:
    """A slide: numbered title, text shapes, then tables between empty lines."""
    head = F.concat(F.lit("# Slide #"), number.cast("string"))
    head = F.when(title.isNotNull(), F.concat(head, F.lit(": "), title)).otherwise(head)
    said = F.transform(F.filter(texts, lambda t: ~is_blank(t)), lambda t: F.concat(t, F.lit("\n")))
    drawn = F.transform(
        F.filter(tables, lambda t: ~is_blank(t)), lambda t: F.concat(F.lit("\n"), t, F.lit("\n\n"))
    )
    return F.concat(head, F.lit("\n\n"), F.array_join(said, ""), F.array_join(drawn, ""))


def page_text(number: Column, blocks: Column) -> Column:
    shown = F.transform(blocks, lambda b: F.concat(b, F.lit("\n\n")))
    return F.concat(F.lit("## Page "), number.cast("string"), F.lit("\n\n"), F.array_join(shown, ""), F.lit("\n"))
