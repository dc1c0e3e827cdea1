"""License notices in documents, found by patience alignment with templates.

Words that occur once in a stretch of text and once in the template are anchors; the longest run of anchors in the order
of both is kept, and the gaps between them are aligned in the same way, where further words are unique. The share of
the template's words that are matched is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import text_chunks
from .license_texts import NOTICES

THRESHOLD = 0.8
STRETCH = 1.25
WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Template:
    """One notice of a license as lower-cased words."""

    name: str
    words: tuple[str, ...]


def templates_of(notices: Mapping[str, Sequence[str]]) -> list[Template]:
    return [Template(name, tuple(WORDS.findall(text.lower()))) for name, texts in notices.items() for text in texts]


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by their first value, whose second value grows; by patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    previous: list[int] = []
    for at, (_, value) in enumerate(pairs):
        pile = bisect_left(tops, value)
        previous.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            ends.append(at)
        else:
            tops[pile], ends[pile] = value, at
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(pairs[at])
        at = previous[at]
    return chain[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), in order.

    Equal words at both ends of a gap are matched; then its unique words; where a gap has none it is left.
    """
    matched, waiting = [], [(0, len(text), 0, len(template))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {word: at for at, word in enumerate(template[c:d], c) if there[word] == 1}
        anchors = [(at, place[word]) for at, word in enumerate(text[a:b], a) if here[word] == 1 and word in place]
        if not anchors:
            continue
        for at, other in _longest_increasing(anchors):
            waiting.append((a, at, c, other))
            matched.append((at, other))
            a, c = at + 1, other + 1
        waiting.append((a, b, c, d))
    return sorted(matched)


def _spans(words: Sequence[str], template: Template, threshold: float) -> Iterator[tuple[int, int, int]]:
    """``(first, last, matched)`` of the stretches of text that cover enough of the template, from left to right.

    A stretch starts at a word of the template and is up to ``STRETCH`` times as long. What it covers cannot be more
    than the template's words in it, so only stretches with enough of them are aligned.
    """
    known = Counter(template.words)
    need = threshold * len(template.words)
    reach = int(len(template.words) * STRETCH) + 2
    places = [at for at, word in enumerate(words) if word in known]
    behind = 0
    end = 0
    for index, at in enumerate(places):
        if at < behind:
            continue
        end = max(end, index)
        while end < len(places) and places[end] < at + reach:
            end += 1
        if end - index < need:
            continue
        found = align(words[at : at + reach], template.words)
        if len(found) >= need and found[0][0] == 0:
            behind = at + found[-1][0] + 1
            yield at, behind - 1, len(found)


def find_notices(text: str, templates: Sequence[Template], threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, start, end)`` of each notice in a text, in characters, by start.

    Of notices that overlap, the one with more matched words stays, then the one with the higher coverage, then the
    earlier, then the first by name.
    """
    words = [word.lower() for word in WORDS.findall(text)]
    present = set(words)
    found = []
    for template in templates:
        if sum(word in present for word in template.words) < threshold * len(template.words):
            continue
        for first, last, matched in _spans(words, template, threshold):
            found.append((-matched, -matched / len(template.words), first, template.name, last))
    if not found:
        return []
    kept: list[tuple[int, int, float, str]] = []
    for _, coverage, first, name, last in sorted(found):
        if all(last < a or first > b for a, b, *_ in kept):
            kept.append((first, last, -coverage, name))
    places = [match.span() for match in WORDS.finditer(text)]
    return [(name, coverage, places[first][0], places[last][1]) for first, last, coverage, name in sorted(kept)]


def scan_licenses(
    docs: DataFrame,
    notices: Mapping[str, Sequence[str]] = NOTICES,
    threshold: float = THRESHOLD,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per notice: ``key``, ``license``, ``coverage``, ``start``, ``end`` (characters) and ``notice`` (its text).

    Words are compared without case and punctuation. A document has a row for each notice in it, also for repeated
    ones; one without notices, or with a null or empty text, has none. Repeated rows are documents of their own; a null
    key stays null; only these columns are returned; an empty table gives no rows. A task reads bounded chunks of texts.
    """
    templates = templates_of(notices)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            picks, hits = [], []
            for at, value in enumerate(chunk.column("text").to_pylist()):
                for name, coverage, start, end in find_notices(value or "", templates, threshold):
                    picks.append(at)
                    hits.append((name, coverage, start, end, value[start:end]))
            keys = chunk.column("key").take(pa.array(picks, pa.int64()))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(values, kind_) for values, kind_ in zip(zip(*hits) if hits else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([keys, *columns], ["key", "license", "coverage", "start", "end", "notice"])

    out = f"key {kind}, license string, coverage double, start bigint, end bigint, notice string"
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)
