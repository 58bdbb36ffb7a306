"""Findings to files and units.

The unit around a line is found by an equi join on path and block of lines. Blocks of 128 lines make
larger ones, 128 at a time, and a unit is present in the largest blocks it fills and in the two it
fills in part: a unit of ten million lines in some hundreds, a line in three. So neither very long
units nor files with very many findings turn into all pairs. Which units a change touches is one
sweep along the lines of a file: all that a unit needs to know of the ranges before its end is how
far they reach, one running value that `with_running` carries over slices of equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.config import DEFAULT_CONFIG, ScanConfig
from inkprint.operators.ordering import join_spread, with_running
from inkprint.operators.score import no_explanation

BLOCK_LINES = 128  # lines of a block, and blocks of a larger one
LEVELS = 3


def _key(level: int, block: Column) -> Column:
    return F.shiftleft(F.lit(level).cast("bigint"), 48).bitwiseOR(block.cast("bigint"))


def _blocks_of_line(line: Column) -> Column:
    return F.array(*[_key(k, F.floor(line / BLOCK_LINES**k)) for k in range(1, LEVELS + 1)])


def _blocks_of_range(first: Column, last: Column) -> Column:
    """The largest blocks that the lines fill, and the smallest ones that they fill in part; none if the range ends before it starts."""
    whole = lambda k: (F.ceil(first / BLOCK_LINES**k), F.floor((last + 1) / BLOCK_LINES**k))
    between = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    keys = lambda level, blocks: F.transform(blocks, lambda b: _key(level, b))
    ends = F.array(F.floor(first / BLOCK_LINES), F.floor(last / BLOCK_LINES))
    found = [keys(1, F.filter(ends, lambda b: (b * BLOCK_LINES < first) | ((b + 1) * BLOCK_LINES - 1 > last)))]
    for k in range(1, LEVELS + 1):
        low, high = whole(k)
        blocks = between(low, high)
        if k < LEVELS:
            above, below = (v * BLOCK_LINES for v in whole(k + 1))
            blocks = F.when(above < below, F.concat(between(low, above), between(below, high))).otherwise(blocks)
        found.append(keys(k, blocks))
    return F.when(first <= last, F.array_distinct(F.concat(*found)))


def unit_of_line(places: DataFrame, units: DataFrame, payload: list[str]) -> DataFrame:
    """The first unit in file order (so the outermost) that contains each (file, line).

    ``places`` are distinct. Places no unit contains are left out.
    """
    spots = places.withColumn("_block", F.explode(_blocks_of_line(F.col("line"))))
    spans = units.select("path", "ordinal", "start_line", "end_line", *payload).withColumn(
        "_block", F.explode(_blocks_of_range(F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint")))
    )
    inside = (
        (spots["file"] == spans["path"])
        & (spots["_block"] == spans["_block"])
        & (spots["line"] >= spans["start_line"])
        & (spots["line"] <= spans["end_line"])
    )
    return (
        spots.join(spans, inside)
        .groupBy(spots["file"], spots["line"])
        .agg(F.min_by(F.struct("ordinal", *payload), F.col("ordinal")).alias("unit"))
    )


def attribute(
    findings: DataFrame, scored: DataFrame, config: ScanConfig = DEFAULT_CONFIG, payload: tuple[str, ...] = ("score", "explained")
) -> DataFrame:
    """Findings with ``ai_score`` and ``explained`` of the unit around them.

    Outside every unit the score is the threshold and the explanation is empty. Repeated
    places (a manifest that takes every dependency finding) are reduced to one before the
    range join; the join back deals a hot place out over salts.
    """
    places = findings.select("file", "line").distinct()
    owners = unit_of_line(places, scored, list(payload))
    joined = join_spread(findings.drop("ai_score", "explained"), owners, ["file", "line"])
    outside = {"score": F.lit(config.threshold), "explained": no_explanation()}
    names = {"score": "ai_score"}
    return joined.select(
        *[c for c in joined.columns if c != "unit"],
        F.col("unit.ordinal").alias("unit_ordinal"),
        *[
            F.coalesce(F.col(f"unit.{p}"), outside[p]).alias(names.get(p, p)) if p in outside
            else F.col(f"unit.{p}").alias(names.get(p, p))
            for p in payload
        ],
    )


def all_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Every scanned path, and every path only a finding names."""
    return files.select("path").union(findings.select(F.col("file").alias("path"))).distinct()


def changed_units(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Units some changed line range of their file touches.

    ``ranges``: ``path, first_line, last_line``. A unit is touched if, of the ranges that begin
    before it ends, one reaches its first line; only keys and line numbers go through the sweep.
    """
    spans = units.select(
        "path", F.col("end_line").cast("bigint").alias("_at"), F.lit(True).alias("_is_unit"), "ordinal", "start_line",
        F.lit(None).cast("bigint").alias("_last"),
    ).filter("start_line <= _at")
    changes = ranges.groupBy("path", "first_line").agg(F.max("last_line").cast("bigint").alias("_last")).filter("_last >= first_line").select(
        "path", F.col("first_line").cast("bigint").alias("_at"), F.lit(False).alias("_is_unit"), "_last"
    )
    events = spans.unionByName(changes, allowMissingColumns=True)
    swept = with_running(events, ["path"], ["_at", "_is_unit", "ordinal"], "_last", "_reach", "max")
    keys = swept.filter(F.col("_is_unit") & (F.col("_reach") >= F.col("start_line"))).select("path", "ordinal").distinct()
    return units.join(keys, ["path", "ordinal"], "left_semi")


def in_changed_files(units: DataFrame, changed: DataFrame) -> DataFrame:
    """Units of the given files only."""
    return units.join(changed.select("path").distinct(), "path", "left_semi")
