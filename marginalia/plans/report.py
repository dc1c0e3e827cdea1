"""One report over several commands, each with instructions of its own, saved in order."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import template_path
from ..operators.model import SYSTEM_PROMPT, Model, fold_instructions
from ..operators.report import combined_output, union_commands
from ..operators.sinks import REPORT_NAME, save_report


class Command(NamedTuple):
    """Outputs ``(ord, out)`` of a command and the instructions that apply to all of them together."""

    outputs: DataFrame
    instructions: tuple[str, ...] = ()


class Report(NamedTuple):
    """Pieces ``(cmd, part, piece, text)`` of a report and the exchanges ``(cmd, step, level, piece, user, assistant)``."""

    pieces: DataFrame
    exchanges: DataFrame | None


def chained_report(
    commands: Sequence[Command | DataFrame], build_model: Callable[[], Model] | None = None, limit: int | None = None, **options
) -> Report:
    """The report of several commands, one after the other.

    Instructions of a command apply to the outputs of that command only; its answer is then its one piece. Commands with
    the same instructions are asked in one go, each on its own. Outputs beyond ``limit`` bytes are answered in
    pieces whose answers are answered again, so no command is ever one value.
    """
    given = [c if isinstance(c, Command) else Command(c) for c in commands]
    rows = union_commands(*(c.outputs.select(F.col("ord").cast("bigint").alias("ord"), "out") for c in given))
    lists = list(dict.fromkeys(tuple(c.instructions) if build_model else () for c in given))
    pieces, exchanges = [], []
    for steps in lists:
        own = [i for i, c in enumerate(given) if (tuple(c.instructions) if build_model else ()) == steps]
        outputs = rows.filter(F.col("cmd").isin(own))
        if not steps:
            pieces.append(combined_output(outputs, ["cmd"], **options))
            continue
        sized = {} if limit is None else {"limit": limit}
        answers, said = fold_instructions(outputs, ["cmd"], steps, build_model, **sized)
        zero = F.lit(0).cast("bigint")
        pieces.append(answers.select("cmd", zero.alias("part"), zero.alias("piece"), F.col("out").alias("text")))
        exchanges.append(said)
    whole = reduce(DataFrame.unionByName, pieces)
    return Report(whole, reduce(DataFrame.unionByName, exchanges) if exchanges else None)


def chat_history(exchanges: DataFrame) -> DataFrame:
    """The exchanges of a report as messages ``(conv_id, turn, role, text)``, one conversation per call."""
    call = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 9, "0") for c in ("cmd", "step", "level", "piece")))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    said = F.array(
        message("system", F.lit(SYSTEM_PROMPT)), message("user", F.col("user")), message("assistant", F.col("assistant"))
    )
    rows = exchanges.select(call.alias("conv_id"), F.posexplode(said).alias("turn", "message"))
    return rows.select("conv_id", "turn", "message.*")


def save_commands(report: DataFrame, root: str, templates: Mapping[int, str], timestamp: str = "", time: str = "") -> list[str]:
    """The report of each command with a template as one file below ``root``; returns the files, in the order of commands."""
    spark = report.sparkSession
    paths = [template_path(F.lit(REPORT_NAME), template, timestamp, time) for template in templates.values()]
    names = list(spark.range(1).select(*(p.alias(str(i)) for i, p in enumerate(paths))).first()) if paths else []
    if len(set(names)) < len(names):
        raise ValueError(f"several commands share an output path: {sorted(names)}")
    targets = [posixpath.join(root, name) for name in names]
    for cmd, target in zip(templates, targets):
        save_report(report.filter(F.col("cmd") == cmd), target, ["part", "piece"], "text")
    return targets
