"""URL verdicts by rules and by a tree of path templates, in DataFrame functions only.

Rules decide the pages they fit. Their verdicts are also the labels of the template tree: per host, path segments
with many siblings become wildcards, sibling branches whose share of blocked pages differs by no more than chance are
pooled, and a template is rejected if its share, smoothed towards that of the nodes above it, is too high.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ALLOW, BLOCK = "allow", "block"
WILDCARD = "*"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for paths that start with ``path`` on ``host`` and its subdomains."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class TemplateSpec:
    """Shape of the tree and limits of its verdicts.

    ``depth`` segments have levels of their own, what follows is one more segment. A node with more than
    ``max_children`` children has one wildcard child instead. Branches whose shares differ by less than ``z`` standard
    errors are pooled. ``strength`` labelled pages of the parent's share are added to each node's own.
    """

    depth: int = 4
    max_children: int = 16
    z: float = 1.96
    strength: float = 2.0
    max_blocked: float = 0.5


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[UrlRule], host: Column, path: Column, value: str) -> Column:
    """``value`` (``name`` or ``verdict``) of the longest rule that fits, else null."""
    ranked = sorted(rules, key=lambda rule: (-len(rule.name), rule.name))
    return F.coalesce(
        F.lit(None).cast("string"), *[F.when(rule.fits(host, path), F.lit(getattr(rule, value))) for rule in ranked]
    )


def shape_of(path: Column, depth: int) -> Column:
    """The segments of a path, runs of digits as wildcards; what follows ``depth`` segments is one segment."""
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", WILDCARD), "/", -1), lambda s: s != "")
    tail = F.array_join(F.slice(segments, depth + 1, F.greatest(F.size(segments), F.lit(1))), "/")
    return F.when(F.size(segments) > depth, F.concat(F.slice(segments, 1, depth), F.array(tail))).otherwise(segments)


def _generalised(shapes: DataFrame, spec: TemplateSpec) -> DataFrame:
    """``shapes`` with ``template``: segments of nodes with many children are wildcards, level by level from the host.

    Children are counted after aggregation, so a hot host is as many rows as it has different children.
    """
    now = shapes.withColumn("template", F.col("shape"))
    for level in range(spec.depth + 1):
        own = F.get("template", F.lit(level))
        parent = F.slice("template", 1, level)
        children = (
            now.filter(own.isNotNull()).groupBy("host", parent.alias("parent"), own.alias("child")).agg(F.sum("n").alias("n"))
        )
        wide = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > spec.max_children)
        wide = wide.select(F.col("host").alias("wide_host"), "parent")
        joined = now.join(wide, (F.col("host") == F.col("wide_host")) & (parent == F.col("parent")), "left")
        replaced = F.concat(
            parent,
            F.array(F.lit(WILDCARD)),
            F.slice("template", level + 2, F.greatest(F.size("template"), F.lit(1))),
        )
        template = F.when(F.col("parent").isNotNull() & own.isNotNull(), replaced).otherwise(F.col("template"))
        now = materialize(joined.select(*shapes.columns, template.alias("template")), "templates")
    return now


def _nodes(templates: DataFrame) -> DataFrame:
    """One row per template and node on its path, from the host (depth 0, no name) down: parent, name and depth."""
    depth = F.col("depth")
    return templates.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("template")))).withColumns(
        {
            "parent": F.slice("template", F.lit(1), F.greatest(depth - 1, F.lit(0))),
            "name": F.coalesce(F.get("template", depth - 1), F.lit("")),
        }
    )


def _pooled(nodes: DataFrame, spec: TemplateSpec) -> DataFrame:
    """Labelled nodes with ``pool_n`` and ``pool_bad``, the counts of all branches pooled with them.

    Siblings are taken by rising share; one joins the pool before it unless its share exceeds that of the whole pool so
    far, so small steps do not add up. A parent has no more children than the tree allows, so the arrays are bounded.
    """
    counted = (
        nodes.groupBy("host", "depth", "parent", "name")
        .agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("bad"))
        .filter(F.col("n") > 0)
    )
    branch = F.struct((F.col("bad") / F.col("n")).alias("share"), "name", "n", "bad")
    siblings = counted.groupBy("host", "depth", "parent").agg(F.sort_array(F.collect_list(branch)).alias("branches"))

    def taken(pools: Column, one: Column) -> Column:
        last = F.get(pools, F.size(pools) - 1)
        n, bad = last["n"] + one["n"], last["bad"] + one["bad"]
        error = F.sqrt(bad / n * (1 - bad / n) * (1 / one["n"] + 1 / last["n"]))
        joins = F.coalesce(one["share"] - last["bad"] / last["n"] <= spec.z * error, F.lit(False))
        longer = F.struct(F.concat(last["names"], F.array(one["name"])).alias("names"), n.alias("n"), bad.alias("bad"))
        own = F.struct(F.array(one["name"]).alias("names"), one["n"].alias("n"), one["bad"].alias("bad"))
        before = F.slice(pools, F.lit(1), F.greatest(F.size(pools) - 1, F.lit(0)))
        return F.when(joins, F.concat(before, F.array(longer))).otherwise(F.concat(pools, F.array(own)))

    none = F.array().cast("array<struct<names:array<string>,n:bigint,bad:bigint>>")
    pools = siblings.select("host", "depth", "parent", F.explode(F.aggregate("branches", none, taken)).alias("pool"))
    return pools.select(
        "host", "depth", "parent", F.explode("pool.names").alias("name"),
        F.col("pool.n").alias("pool_n"), F.col("pool.bad").alias("pool_bad"),
    )


def _decided(nodes: DataFrame, pooled: DataFrame, prior: float, spec: TemplateSpec) -> DataFrame:
    """Shapes of hosts with labelled pages, and whether they are ``rejected``.

    A node's share is its pool's, smoothed by ``strength`` pages of its parent's smoothed share, from the share of all
    labelled pages through the host downwards; a node without labelled pages so has its nearest ancestor's.
    """
    counts = F.struct("depth", F.coalesce("pool_n", F.lit(0)).alias("n"), F.coalesce("pool_bad", F.lit(0)).alias("bad"))
    paths = (
        nodes.select("host", "shape", "depth", "parent", "name")
        .join(pooled, ["host", "depth", "parent", "name"], "left")
        .groupBy("host", "shape")
        .agg(F.sort_array(F.collect_list(counts)).alias("path"))
        .filter(F.col("path")[0]["n"] > 0)
    )
    share = F.aggregate(
        "path", F.lit(float(prior)), lambda above, at: (at["bad"] + spec.strength * above) / (at["n"] + spec.strength)
    )
    return paths.select("host", "shape", (share > spec.max_blocked).alias("rejected"))


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], key: str = "page_id", url: str = "url", spec: TemplateSpec = TemplateSpec()
) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule``, ``template`` and ``verdict``.

    The longest rule that fits decides. A page without a rule is decided by its template's smoothed share of blocked
    pages, which is that of the nearest labelled node above where the template has no labelled page; on a host without
    any labelled page it is allowed. A url that is null or has no ``://`` has an empty host and path, no rule and no
    part in the tree, and is allowed. Repeated rows stay repeated, other columns are not carried, an empty table gives
    no rows.

    Urls are read once; the tree works on different shapes per host with their counts. Verdicts of shapes are joined
    back on host and shape, where Spark broadcasts a small side and splits a hot host otherwise.
    """
    parsed = pages.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = materialize(
        parsed.select(
            "*",
            longest_rule(rules, host, path, "name").alias("rule"),
            longest_rule(rules, host, path, "verdict").alias("label"),
            shape_of(path, spec.depth).alias("shape"),
        ),
        "urls",
    )
    shapes = materialize(
        rows.filter(host != "")
        .groupBy("host", "shape")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("label").alias("labelled"),
            F.count(F.when(F.col("label") == BLOCK, 1)).alias("blocked"),
        ),
        "shapes",
    )
    labelled, blocked = shapes.agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = blocked / labelled if labelled else 0.0
    templates = _generalised(shapes, spec)
    nodes = _nodes(templates)
    decided = _decided(nodes, _pooled(nodes, spec), prior, spec)
    known = templates.select("host", "shape", "template").join(decided, ["host", "shape"], "left")
    own = F.when(F.col("rejected"), BLOCK).otherwise(ALLOW)
    return rows.join(known, ["host", "shape"], "left").select(
        F.col("key").alias(key), "host", "path", "rule",
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        F.coalesce("label", own).alias("verdict"),
    )
