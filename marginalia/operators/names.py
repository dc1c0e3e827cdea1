"""Distinct output names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import slug_path
from .joins import join_keys
from .numbering import numbered


def unique_slug(pages: DataFrame, folder: str = "web-pages") -> DataFrame:
    """A name per page URL; pages that share a name get a numbered suffix.

    Pages of one name are numbered by the digest of their URL, sliced by its first digits, so a name that
    very many URLs share is numbered by many tasks and a rerun gives the same names. Only ids and URLs are
    numbered; the few pages that need a suffix are joined back by both. A page that is given twice gets
    each of its numbers twice, so give each page once.
    """
    slug = slug_path(F.col("url"), folder)
    named = pages.select("page_id", "url", slug.alias("slug"), F.md5("url").alias("__digest"))
    order = [F.col("__digest"), F.col("page_id")]
    placed = numbered(named, ["slug"], order, F.substring("__digest", 1, 3), "__n")
    later = placed.filter(F.col("__n") > 1).select("page_id", "url", "__n")
    suffix = F.coalesce(F.concat(F.lit("-"), F.col("__n").cast("string")), F.lit(""))
    joined = join_keys(pages.withColumn("slug", slug), later, ["page_id", "url"], "left")
    return joined.withColumn("name", F.concat(F.col("slug"), suffix)).drop("__n")
