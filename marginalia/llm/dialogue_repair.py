"""Repair of the structure of conversations: faults, cheapest edits and their audit, at any length of a conversation.

The turns of a conversation are numbered over ranges and cut into blocks. A block gives, for each state in which it may be
entered and left, the cost and the letters of its best edits. Costs are then added up from the last block to the first,
and from the first to the last each block takes the state that leads to the cheapest whole and, among these, the letters
that come first. Both passes read the blocks of a conversation as a stream in order, and so does the digest, so no task
holds more of a conversation than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import placed
from ..session import materialize
from .edit_paths import ENDING, START, STATES, paths, unfold
from .text import SPACES

BLOCK = 256
END = ".!?"
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 40


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(column.to_pylist() for column in batch.columns)) for batch in batches)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``fault``: ``blank``, ``duplicate``, ``truncated`` or null, the first that holds.

    Turns have ``conv``, ``pos``, ``role`` and ``text``. Which texts a conversation repeats is counted by their digests,
    and only where something is repeated the turns are joined with the place where it came first.
    """
    body = F.btrim("text", F.lit(SPACES))
    blank = F.length(body) == 0
    marked = turns.withColumns({"blank": blank, "digest": F.sha2(F.col("text").cast("binary"), 256)})
    first = marked.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times"))
    repeated = first.filter("times > 1").drop("times")
    judged = marked.join(repeated, ["conv", "role", "digest"], "left")
    cut_off = ~F.right(body, F.lit(1)).isin(*END)
    fault = (
        F.when(F.col("blank"), "blank").when(F.coalesce(F.col("pos") > F.col("first"), F.lit(False)), "duplicate").when(cut_off, "truncated")
    )
    return judged.select(*turns.columns, fault.alias("fault"))


def _block_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From turns in order ``(conv, block, pos, initial, kind)`` a row per block; ``exits[4 * entry + exit]``."""
    names = ["conv", "block", "initials", "costs", "letters"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    made = []
    for (conv, block), group in groupby(_rows(batches), key=itemgetter(0, 1)):
        rows = list(group)
        initials, flaws = "".join(r[3] for r in rows), [r[4] for r in rows]
        costs, letters = [FAR] * STATES * STATES, [""] * STATES * STATES
        for entry in range(STATES) if block else (START,):
            for exit_, (cost, text) in paths(initials, flaws, entry).items():
                costs[STATES * entry + exit_], letters[STATES * entry + exit_] = cost, text
        made.append((conv, block, initials, costs, letters))
        if len(made) == 64:
            yield _batch(made, names, kinds)
            made = []
    yield _batch(made, names, kinds)


def _costs_to_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks ``(conv, block, costs)``, the last of a conversation first, what is still to pay after each block."""
    names, kinds = ["conv", "block", "last", "rest"], [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    ending = [ENDING[state][0] for state in range(STATES)]
    made = []
    for conv, group in groupby(_rows(batches), key=itemgetter(0)):
        rest, last = ending, True
        for _, block, costs in group:
            made.append((conv, block, last, rest))
            rest, last = [min(costs[STATES * s + t] + rest[t] for t in range(STATES)) for s in range(STATES)], False
            if len(made) == 1024:
                yield _batch(made, names, kinds)
                made = []
    yield _batch(made, names, kinds)


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks in order the way through each: ``(conv, block, cost, audit, edits)``, ``edits`` being those of each turn."""
    edit = pa.struct([("before", pa.string()), ("edit", pa.string()), ("after", pa.string())])
    names = ["conv", "block", "cost", "audit", "edits"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(edit)]
    made = []
    for conv, group in groupby(_rows(batches), key=itemgetter(0)):
        state = START
        for _, block, initials, costs, letters, last, rest in group:
            own = range(STATES * state, STATES * state + STATES)
            least = min(costs[k] + rest[k % STATES] for k in own)
            ends = {k: ENDING[k % STATES] if last else (0, "") for k in own}
            at = min((k for k in own if costs[k] + rest[k % STATES] == least), key=lambda k: letters[k] + ends[k][1])
            unfolded = [{"before": b, "edit": e, "after": ""} for b, e in unfold(initials, letters[at], state)]
            state = at % STATES
            extra, added = ends[at]
            unfolded[-1]["after"] = {0: "", 1: "a", 2: "ua"}[len(added)]
            made.append((conv, block, costs[at] + extra, letters[at] + added, unfolded))
            if len(made) == 64:
                yield _batch(made, names, kinds)
                made = []
    yield _batch(made, names, kinds)


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Two tables about the conversations of ``turns``: their ``verdicts`` and their repaired ``turns``.

    Verdicts, one row per conversation: ``conv``, ``gaps`` in its turn numbers, counts of ``blank``, ``duplicate`` and
    ``truncated`` turns (the first fault of each), ``illegal`` neighbours, and ``cost`` and ``audit`` of the cheapest edits.
    Repaired turns: ``conv``, ``pos``, ``nth`` (their order), ``role``, ``text``.

    Turns are taken by number, null first; of one number by role and text, bytewise. Null roles and texts count as one
    space; a role that begins with none of s, u and a fits nowhere and has to be changed or deleted. A null conversation is one of its own. Repeated rows are turns of their own,
    other columns are not read, an empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    shown = turns.select(
        key.alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    numbered = placed(shown, ["conv"], ["turn", "role", "text"], "pos")
    judged = materialize(faults(numbered), "turns")

    kind = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    cut = F.expr(f"pos div {block}").alias("block")
    small = judged.select("conv", cut, "pos", initial.alias("initial"), kind.alias("kind"))
    state = "conv string, block bigint, initials string, costs array<bigint>, letters array<string>"
    blocks = materialize(_in_order(small, ["conv", "block"], ["pos"]).mapInArrow(_block_paths, state), "blocks")

    back = blocks.select("conv", "block", "costs").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    rest = back.mapInArrow(_costs_to_go, "conv string, block bigint, last boolean, rest array<bigint>")
    ahead = _in_order(blocks.join(rest, ["conv", "block"]), ["conv"], ["block"])
    ahead = ahead.select("conv", "block", "initials", "costs", "letters", "last", "rest")
    edit = "array<struct<before: string, edit: string, after: string>>"
    chosen = materialize(ahead.mapInArrow(_choices, f"conv string, block bigint, cost bigint, audit string, edits {edit}"), "choices")

    pieces = F.sort_array(F.collect_list(F.struct("block", "audit")))
    audits = chosen.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit")
    )
    verdicts = _counts(judged).join(_illegal(blocks), "conv").join(audits, "conv")
    types = dict(turns.select(F.col(conv).alias("conv")).dtypes)
    back_to = lambda rows: rows.withColumn("conv", F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(types["conv"]))
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return back_to(verdicts.select(*names)), back_to(_repaired(judged, chosen, block))


def _counts(judged: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation; turn numbers are made different before they are counted."""
    numbers = judged.filter("turn IS NOT NULL").select("conv", "turn").distinct()
    gaps = numbers.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("bigint").alias("gaps"))
    counted = judged.groupBy("conv").agg(*(F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")))
    return counted.join(gaps, "conv", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("bigint")))


def _illegal(blocks: DataFrame) -> DataFrame:
    """Neighbours, by initials, that are none of su, ua and au, within blocks and across their borders."""
    pair = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda k: F.substring(F.col("initials"), k, F.lit(2)))
    within = F.size(F.filter(pair, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).cast("bigint")
    ends = blocks.select("conv", "block", within.alias("n"), F.left("initials", F.lit(1)).alias("first"), F.right("initials", F.lit(1)).alias("end"))
    before = ends.select("conv", (F.col("block") + 1).alias("block"), F.col("end").alias("before"))
    across = F.concat("before", "first")
    bordered = ends.join(before, ["conv", "block"], "left")
    illegal = F.col("n") + F.coalesce((~across.isin("su", "ua", "au")).cast("bigint"), F.lit(0))
    return bordered.groupBy("conv").agg(F.sum(illegal).cast("bigint").alias("illegal"))


def _repaired(judged: DataFrame, chosen: DataFrame, block: int) -> DataFrame:
    """The turns after the edits, in the order of ``pos`` and ``nth``."""
    edits = chosen.select("conv", "block", F.posexplode("edits").alias("at", "e"))
    placed_ = edits.select("conv", (F.col("block") * block + F.col("at")).alias("pos"), "e.*")
    joined = judged.select("conv", "pos", "role", "text").join(placed_, ["conv", "pos"])
    named = lambda initial: F.when(initial == "u", ROLES["u"]).otherwise(ROLES["a"])
    empty = lambda letters: F.transform(
        F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.struct(named(c).alias("role"), F.lit("").alias("text"))
    )
    own = F.struct(F.when(F.col("edit") == "K", F.col("role")).otherwise(named(F.col("edit"))).alias("role"), F.col("text").alias("text"))
    kept = F.when(F.col("edit") == "D", F.expr("cast(array() as array<struct<role: string, text: string>>)")).otherwise(F.array(own))
    rows = F.posexplode(F.concat(empty(F.col("before")), kept, empty(F.col("after")))).alias("nth", "t")
    return joined.select("conv", "pos", rows).select("conv", "pos", "nth", "t.role", "t.text")


def turns_digest(turns: DataFrame) -> DataFrame:
    """``(conv, digest)``: SHA-256 of the lines ``role:text`` of repaired turns, read as a stream in order.

    A conversation is one value to digest, so its turns meet in one task; only a batch of them is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds, made = ["key", "digest"], [pa.string(), pa.string()], []
        for key, group in groupby(_rows(batches), key=itemgetter(0)):
            digest, mark = sha256(), b""
            for row in group:
                digest.update(mark + f"{row[3]}:{row[4]}".encode())
                mark = b"\n"
            made.append((key, digest.hexdigest()))
            if len(made) == 1024:
                yield _batch(made, names, kinds)
                made = []
        yield _batch(made, names, kinds)

    kind = dict(turns.dtypes)["conv"]
    shown = turns.select(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("key"), "pos", "nth", "role", "text")
    digests = _in_order(shown, ["key"], ["pos", "nth"]).mapInArrow(run, "key string, digest string")
    return digests.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv"), "digest")
