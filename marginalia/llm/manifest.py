"""A Merkle manifest of a dataset: digests of rows, of sources and of the whole, with a proof for each row.

Each source is a tree of nodes with ``FANOUT`` children over its rows in the order of their ids; the roots of the
sources are the leaves of one more tree. Leaves meet in superblocks, subtrees of ``LEVELS`` levels. On the way up a
superblock leaves only its top node, and the tops are cut into superblocks again until one is left. On the way down
the nodes of a superblock are cogrouped with what lies outside it, the path above its top; the reduction inside is then
finished, joined to that path and folded in one go. So a task holds one superblock, whatever the size of a source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import placed
from ..session import materialize

FANOUT = 3
LEVELS = 6
#: Stands for the node itself in a step of a proof.
HERE = "*"


def _field(value: Column) -> Column:
    shown = value.cast("string")
    sized = F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown)
    return F.coalesce(sized, F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, ``-`` for null."""
    return F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.replace(step, F.lit(HERE), node), 256))


def proof_text(proof: Column) -> Column:
    """The siblings of a proof from the leaf to the root, left to right, in one string."""
    return F.replace(F.array_join(proof, ""), F.lit(HERE), F.lit(""))


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _reduced(rows: pd.DataFrame, levels: int) -> list[list[str]]:
    """The levels of one superblock, whose leaves are sorted, from these on.

    One that is its whole tree ends at one node; one of several always has ``levels`` levels above its leaves.
    """
    made, alone = [rows["node"].tolist()], rows["n"].iloc[0] <= FANOUT**levels
    while len(made[-1]) > 1 if alone else len(made) <= levels:
        row = made[-1]
        made.append([_digest("".join(row[at : at + FANOUT])) for at in range(0, len(row), FANOUT)])
    return made


def _steps(made: list[list[str]], at: int) -> Iterator[str]:
    """The steps from one leaf of a superblock to its top: the run that is hashed, with the node itself left open."""
    for row in made[:-1]:
        start = at - at % FANOUT
        yield "".join(HERE if place == at else row[place] for place in range(start, min(start + FANOUT, len(row))))
        at //= FANOUT


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FANOUT**levels}"))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """``(tree, pos, n, node)`` of the level above the superblocks of ``nodes``, which have the same columns."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        first, size = rows.iloc[0], FANOUT**levels
        top = _reduced(rows, levels)[-1][0]
        above = [(first["tree"], int(first["pos"]) // size, -(-int(first["n"]) // size), top)]
        return pd.DataFrame(above, columns=["tree", "pos", "n", "node"])

    grouped = _blocks(nodes, levels).groupBy("tree", "block")
    return grouped.applyInPandas(reduce, "tree string, pos bigint, n bigint, node string")


def _climb(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The layers of all trees from their leaves to their roots; each is written, so lineage ends there."""
    layers = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        layers.append(materialize(_tops(layers[-1].select("tree", "pos", "n", "node"), levels), "nodes"))
        largest = -(-largest // FANOUT**levels)
    return layers


def _descend(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The path above each node of a layer: ``(tree, block, steps, subroot, root)``, ``block`` being the node's place.

    ``outer`` has the same columns for the superblocks of the layer.
    """

    def join(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, path = rows.sort_values("pos"), above.iloc[0]
        made = _reduced(rows, levels)
        steps = [[*_steps(made, at), *path["steps"]] for at in range(len(rows))]
        same = {"subroot": path["subroot"], "root": path["root"]}
        return pd.DataFrame({"tree": rows["tree"], "block": rows["pos"], "steps": steps, **same})

    left = _blocks(nodes, levels).groupBy("tree", "block")
    schema = "tree string, block bigint, steps array<string>, subroot string, root string"
    return left.cogroup(outer.groupBy("tree", "block")).applyInPandas(join, schema)


def _prove(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """``(tree, key, leaf, subroot, root, proof, folded_root)`` per leaf; ``claimed`` is the leaf that is folded, if given."""

    def join(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, path = rows.sort_values("pos"), above.iloc[0]
        made = _reduced(rows, levels)
        proofs, folded = [], []
        for at, (own, claimed) in enumerate(zip(rows["node"], rows["claimed"])):
            proof = [*_steps(made, at), *path["steps"]]
            node = claimed or own
            for step in proof:
                node = _digest(step.replace(HERE, node))
            proofs.append(proof)
            folded.append(node)
        same = {"subroot": path["subroot"], "root": path["root"]}
        own = {"tree": rows["tree"], "key": rows["key"], "leaf": rows["node"]}
        return pd.DataFrame({**own, **same, "proof": proofs, "folded_root": folded})

    left = _blocks(leaves, levels).groupBy("tree", "block")
    schema = "tree string, key string, leaf string, subroot string, root string, proof array<string>, folded_root string"
    return left.cogroup(outer.groupBy("tree", "block")).applyInPandas(join, schema)


def manifest(
    rows: DataFrame,
    leaf: Column,
    source: str = "source",
    key: str = "doc_id",
    claimed: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row: ``key``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof`` and ``folded_root``.

    ``leaf`` is the digest of a row. ``proof`` has a step per level, leaf to root: the run that is hashed with the node
    itself shown as ``*``, so that ``fold`` and ``proof_text`` read it. ``folded_root`` is where the proof leads from
    ``claimed`` (a digest of what the row is now) or, where that is null, from the leaf. A superblock has ``levels``
    levels above its leaves, 3 to that power of them; the result does not depend on it.

    Rows of a source ascend by key, null keys first, rows of one key by their digest, so equal rows may change places
    without a change of the result. Sources ascend bytewise, null first. Repeated rows are leaves of their own, an empty
    table gives no rows, other columns of ``rows`` are not read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    marked = rows.select(
        tree.alias("tree"),
        F.col(key).alias("key"),
        leaf.alias("node"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranked = placed(materialize(marked, "leaves"), ["tree"], ["key", "node", "row"], "pos")
    leaves = _sized(ranked)
    layers = _climb(leaves, levels)
    roots = layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node")
    tops = _sized(placed(roots, ["tree"], ["of"], "pos"))
    above = _climb(tops, levels)
    root = above[-1].select("tree", F.lit(0).cast("bigint").alias("block"), "node")
    outer = root.select("tree", "block", F.array().cast("array<string>").alias("steps"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for layer in reversed(above[:-1]):
        outer = materialize(_descend(layer.select("tree", "pos", "n", "node"), outer, levels), "paths")
    outer = tops.join(outer.withColumnRenamed("block", "pos").select("pos", "steps", "root"), "pos").select(
        F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("block"), "steps", F.col("node").alias("subroot"), "root"
    )
    for layer in reversed(layers[1:-1]):
        outer = materialize(_descend(layer.select("tree", "pos", "n", "node"), outer, levels), "paths")
    asked = leaves.select("tree", "pos", "n", "node", "claimed", F.col("key").cast("string").alias("key"))
    proved = _prove(asked, outer, levels)
    # Keys and sources go through pandas as text, where a long with nulls would become a float.
    types = dict(rows.select(F.col(key).alias("key"), F.col(source).alias("source")).dtypes)
    origin = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).cast(types["source"])
    return proved.select(
        F.col("key").cast(types["key"]).alias(key), origin.alias(source), "leaf", "subroot", "root", "proof", "folded_root"
    )


def _sized(ranked: DataFrame) -> DataFrame:
    """Nodes with ``n``, the number of leaves of their tree; the few totals are joined by Spark's choice."""
    totals = ranked.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return materialize(ranked.join(totals, "tree"), "placed")
