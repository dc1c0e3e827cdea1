"""Search stored pages and show hits; fetch requested pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model import Model, apply_instructions, instructions_for_page, query_substitution
from ..operators.search import (
    accepted_requests,
    invalid_requests,
    page_get,
    search_section,
    select_hits,
)
from ..session import materialize
from ..spec import Instruction, SearchSpec


def web_search(
    spark,
    queries: Sequence[str],
    hits: DataFrame,
    pages: DataFrame,
    spec: SearchSpec,
    build_model: Callable[[], Model] | None = None,
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Report rows ``(query, ord, out)``: the hit section and, if asked, one block per page.

    ``hits`` are ``(query, url)`` rows and their ``order`` from a search over pages (``page_id``) or from stored
    responses (``offset``, ``pos``). Instructions for pages imply fetching and stripping them.
    """
    chosen = materialize(select_hits(hits, spec.max_results, spec.exclude_urls, spec.own_hosts, order), "hits")
    get = spec.get_content or bool(spec.instructions)
    strip = spec.strip or (bool(spec.instructions) and not spec.get_content)
    if not get:
        section = search_section(spark, queries, chosen, spec.provider)
        return section.select("query", F.lit(0).alias("ord"), "out")
    section = search_section(spark, queries, chosen, spec.provider)
    if not spec.instructions or build_model is None:
        blocks = page_get(chosen.select("query", F.col("rank").alias("ord"), "url"), pages, strip)
        head = section.select("query", F.lit(0).alias("ord"), "out")
        return head.unionByName(blocks.select("query", "ord", "out"))
    requests = chosen.select("query", F.col("rank").alias("ord"), "url")
    blocks = page_get(requests, pages, strip)
    texts = F.transform(
        instructions_for_page(F.col("url"), spec.instructions, lower=True),
        lambda i: query_substitution(i["instruction"], F.col("query")),
    )
    answered = apply_instructions(blocks, "out", texts, build_model)
    head = section.select("query", F.lit(0).alias("ord"), "out")
    return head.unionByName(answered.select("query", "ord", "out"))


def web_get(
    requests: DataFrame,
    pages: DataFrame,
    strip: bool = False,
    key: str = "request",
    instructions: Sequence[Instruction] = (),
    build_model: Callable[[], Model] | None = None,
    **options,
) -> DataFrame:
    """Blocks of requested pages, for request lists without a bad URL; instructions apply as their criteria say."""
    blocks = page_get(accepted_requests(requests, key), pages, strip)
    if not instructions or build_model is None:
        return blocks
    texts = F.transform(instructions_for_page(F.col("url"), instructions), lambda i: i["instruction"])
    return apply_instructions(blocks, "out", texts, build_model, **options)


def web_get_report(requests: DataFrame, pages: DataFrame, key: str = "request", **options) -> DataFrame:
    """Report rows ``(key, ord, out)`` of all request lists.

    A list with a bad URL has its message instead of pages: a line for each bad one, below a heading with a null
    ``ord`` if there are several.
    """
    messages = invalid_requests(requests, key).withColumnRenamed("line", "out")
    return messages.unionByName(web_get(requests, pages, key=key, **options).select(key, "ord", "out"))
