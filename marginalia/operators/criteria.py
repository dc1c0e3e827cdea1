"""Instructions and exclusions that are tables: rules with criteria, matched to items by equi joins.

Each item gives the keys under which a rule that applies to it could be filed, each rule is filed under keys of its own, and
what meets is tested as it is. So neither the number of rules nor that of items is limited, and no join compares all
with all. The same rules as options of a run are expressions in ``operators.model``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rules for every item are filed under this many keys, and an item asks under one of them.
SPREAD = 64
#: Criteria are filed by their longest start of one of these lengths.
LENGTHS = (1, 2, 4, 8, 16, 32)


def _after_dots(text: Column) -> Column:
    """What follows each dot of a text."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.substring(text, k, F.lit(1)) == ".")
    return F.transform(places, lambda k: F.substring(text, k + 1, F.length(text)))


def _dotted(endings: Column) -> Column:
    return F.transform(endings, lambda s: F.concat(F.lit("."), s))


def _everywhere(item: Column) -> Column:
    return F.concat(F.lit("*"), F.pmod(F.xxhash64(item), F.lit(SPREAD)).cast("string"))


def _joined(items: DataFrame, rules: DataFrame, asked: Column, filed: Column, applies: Column) -> DataFrame:
    """Items meet the different criteria first, and those that apply are then joined with their rules.

    So a pair of item and criteria is tested once, however many rules share the criteria. Criteria of many rules are
    ``SPREAD`` keys of the second join, by a hash of the item, so that a task makes a share of their rows.
    """
    given = rules.filter(F.col("criteria").isNotNull()).select("ord", "criteria", "instruction")
    spread = F.when(F.count(F.lit(1)) >= SPREAD, SPREAD).otherwise(1).alias("__spread")
    different = materialize(given.groupBy("criteria").agg(spread), "criteria")
    asking = items.withColumn("__key", F.explode(F.array_distinct(asked)))
    met = F.left("__key", F.lit(1))
    passes = met.isin("*", "=") | applies  # these keys say it all
    kept = [*items.columns, "criteria", "__spread"]
    found = asking.join(different.withColumn("__key", F.explode(filed)), "__key").filter(passes).select(*kept)
    salted = found.withColumn("__salt", F.pmod(F.xxhash64(*items.columns), F.col("__spread")).cast("int")).drop("__spread")
    salts = F.explode(F.sequence(F.lit(0), F.col("__spread") - 1)).alias("__salt")
    dealt = given.join(different.select("criteria", salts), "criteria")
    return salted.join(dealt, ["criteria", "__salt"]).select(*items.columns, "ord", "criteria", "instruction")


def _filed(*own: Column) -> Column:
    """A rule's keys: those of its criteria, or all of those that every item may ask under."""
    everywhere = F.array(*(F.lit(f"*{n}") for n in range(SPREAD)))
    return F.when(F.col("criteria") == "", everywhere).otherwise(F.array_compact(F.array(*own)))


def match_files(items: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """One row per item and rule ``(ord, criteria, instruction)`` that applies to its path.

    A rule without criteria applies to all; else the path ends with a dot and the criteria, or is the criteria. Items need
    not differ, repeated rules apply repeatedly, rules with null criteria and items with a null path never.
    """
    own = F.col(path)
    endings = F.filter(_after_dots(own), lambda s: s != "")
    asked = F.concat(F.array(_everywhere(own), F.concat(F.lit("="), own)), _dotted(endings))
    criteria = F.col("criteria")
    applies = own.endswith(F.concat(F.lit("."), criteria))
    filed = _filed(F.concat(F.lit("="), criteria), F.concat(F.lit("."), criteria))
    return _joined(items.filter(own.isNotNull()), rules, asked, filed, applies)


def match_pages(items: DataFrame, rules: DataFrame, url: str = "url", lower: bool = False) -> DataFrame:
    """As above for URLs: the criteria stand behind a dot anywhere in the URL, or are the URL.

    A search lower-cases the criteria (``lower``). What follows each dot is asked for by its starts of a few lengths, so a
    URL asks under some keys per dot, whatever the criteria.
    """
    own = F.col(url)
    cut = lambda s: F.transform(F.array(*map(F.lit, LENGTHS)), lambda n: F.when(F.length(s) >= n, F.concat(F.lit("."), F.left(s, n))))
    starts = F.array_compact(F.flatten(F.transform(_after_dots(own), cut)))
    asked = F.concat(F.array(_everywhere(own), F.concat(F.lit("="), own)), starts)
    given = rules.withColumn("criteria", F.lower("criteria")) if lower else rules
    criteria = F.col("criteria")
    longest = F.lit(None).cast("string")
    for n in LENGTHS:
        longest = F.when(F.length(criteria) >= n, F.concat(F.lit("."), F.left(criteria, F.lit(n)))).otherwise(longest)
    applies = F.contains(own, F.concat(F.lit("."), criteria))
    return _joined(items.filter(own.isNotNull()), given, asked, _filed(F.concat(F.lit("="), criteria), longest), applies)


def exclude_by_table(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Files that no line of a table ``(line)`` of plain ignore lines excludes.

    A line that ends with a slash takes all below that folder, ``*.ext`` all names with that ending, and any other line
    without a wildcard the path itself. Lines of these kinds are met by keys; a line with other wildcards or with a regex is
    an option of a run (``operators.select.ignore_rules``) and an error here. Case does not count, null paths stay.
    """
    line = F.btrim("line")
    folder, suffix = line.endswith("/"), line.rlike(r"^\*\.[^*?/\\]+$")
    plain = ~line.rlike(r"[*?\\]")
    wrong = rules.filter(F.col("line").isNotNull() & (line != "") & ~suffix & ~plain).select("line").limit(1).collect()
    if wrong:
        raise ValueError(f"an ignore line of a table is a folder, *.ending or a path: {wrong[0][0]!r}")
    kind = F.when(folder, F.concat(F.lit("/"), F.lower(line))).when(suffix, F.lower(F.substring(line, F.lit(2), F.length(line))))
    filed = rules.filter(line != "").select(kind.otherwise(F.concat(F.lit("="), F.lower(line))).alias("__key")).distinct()
    own = F.lower(F.col(path))
    parts = F.split(own, "/")
    folders = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")),
    )
    name = F.element_at(parts, -1)
    keys = F.concat(F.array(F.concat(F.lit("="), own)), folders, _dotted(_after_dots(name)))
    asking = files.filter(F.col(path).isNotNull()).select(F.col(path).alias("__path"), F.explode(keys).alias("__key"))
    excluded = asking.distinct().join(filed, "__key").select("__path").distinct()
    return files.join(excluded, F.col(path) == F.col("__path"), "left_anti")
