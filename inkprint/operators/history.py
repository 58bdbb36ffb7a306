"""Scan history, retention, trends and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.functions.scalars import half_up, trim_ws
from inkprint.operators.ordering import trailing_count, with_first, with_previous
from inkprint.sources import schemas

# --- retention ------------------------------------------------------------------------


def newest(rows: DataFrame, order: str, keep: int, *ties: str) -> DataFrame:
    """The newest rows of a table. A top-k, never a sort of the whole table."""
    return rows.orderBy(F.col(order).desc(), *[F.col(t).desc() for t in ties]).limit(keep)


def kept_scans(scans: DataFrame) -> DataFrame:
    return newest(scans, "created_at", fixed.SCANS_KEPT, "scan_id")


def findings_of(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings of the given scans."""
    return findings.join(scans.select("scan_id"), "scan_id", "left_semi")


def add_scan(scans: DataFrame, findings: DataFrame, scan: DataFrame, its_findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with one more scan, cut to the newest, evicted findings dropped."""
    kept = kept_scans(scans.unionByName(scan))
    return kept, findings_of(findings.unionByName(its_findings), kept)


def scan_by_id(scans: DataFrame, scan_id: str) -> DataFrame:
    return scans.filter(F.col("scan_id") == scan_id)


def findings_by_scan(findings: DataFrame, scan_id: str) -> DataFrame:
    return findings.filter(F.col("scan_id") == scan_id)


def latest_findings(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the newest scan, found by a scalar subquery and a plain filter."""
    latest = scans.agg(F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("scan_id"))
    return findings.filter(F.col("scan_id") == latest.scalar())


# --- history lines -----------------------------------------------------------------------


def _solid(lines: DataFrame) -> DataFrame:
    """Lines without the white space around them; blank ones are gone."""
    return lines.withColumn("line", trim_ws(F.col("line"))).filter("line != ''")


def retained_history(lines: DataFrame, keep: int = fixed.HISTORY_LINES_KEPT) -> DataFrame:
    """The last ``keep`` lines that are not blank (``seq``, ``line``)."""
    return newest(_solid(lines), "seq", keep)


def recent_history(lines: DataFrame, limit: int = 3) -> DataFrame:
    """The last lines first, then only those of them that parse; newest on top."""
    last = newest(_solid(lines), "seq", max(1, limit))
    # only what is no JSON is dropped: a missing field, or one of another type, is null
    field = lambda name: F.get_json_object("line", f"$.{name}")
    typed = [(part.split()[0], part.split()[1]) for part in schemas.HISTORY.split(", ")]
    sound = last.filter(F.try_parse_json("line").isNotNull() & (F.col("line") != "null"))
    return sound.select("seq", *(field(n).try_cast(t).alias(n) for n, t in typed)).orderBy(F.col("seq").desc())


def history_line(labels: DataFrame) -> DataFrame:
    """the labels (``seq, label``; a few lines) newest first in one text, or ``history: none``."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "label")), asc=False), lambda e: e["label"]), " | ")
    return labels.agg(F.concat(F.lit("history: "), F.coalesce(F.nullif(joined, F.lit("")), F.lit("none"))).alias("line"))


# --- scan rows ---------------------------------------------------------------------------


def scan_rows(summary: DataFrame, failed: Column | None = None) -> DataFrame:
    """One row per scan for the interface; failed and empty scans become zero rows."""
    counts = ("files_scanned", "total_units", "flagged_units", "ai_percentage", "critical", "high", "medium", "low")
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    zeroed = lambda c: F.when(bad, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    rest = [c for c in summary.columns if c not in counts]
    return summary.select(
        *rest, F.when(bad, "FAILED").otherwise("COMPLETED").alias("status"), *[zeroed(c).alias(c) for c in counts]
    )


def api_findings(findings: DataFrame) -> DataFrame:
    """Findings as the interface lists them, with at most five top signals."""
    return findings.select(
        "id", "severity", "type", "category", "message", "file", "line", "column", "source", "ai_score", "code",
        "rule_id", F.slice("explained.top_signals", 1, 5).alias("top_signals"),
    )


def latest_status(log: DataFrame) -> DataFrame:
    """The last logged status of every scan."""
    return log.groupBy("scan_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def repos_within_limits(files: DataFrame, max_bytes: int | Column = fixed.REPO_SIZE_LIMIT, max_files: int | None = None) -> DataFrame:
    """Repositories whose files stay below the limits, with their sizes."""
    sizes = files.groupBy("repo").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
    kept = sizes.filter(F.col("bytes") <= max_bytes)
    return kept if max_files is None else kept.filter(F.col("files") <= max_files)


# --- trends and limits -------------------------------------------------------------------


def change_percent(now: Column, before: Column) -> Column:
    return F.when(before != 0, half_up((now - before) / F.abs(before) * 100))


def direction(now: Column, before: Column) -> Column:
    return (
        F.when(before.isNull() | (now == before), "stable").when(now > before, "increasing").otherwise("decreasing")
    )


def score_trend(history: DataFrame, ties: str = "seq") -> DataFrame:
    """Every scan of a target against the one before and against the first.

    ``history``: ``target, ts, score`` and a tie breaker.
    """
    chained = with_previous(history, ["target"], ["ts", ties], ["score"])
    chained = with_first(chained, ["target"], ["ts", ties], ["score"])
    now, before, first = F.col("score"), F.col("prev_score"), F.col("first_score")
    return chained.withColumns({
        "direction": direction(now, before),
        "change_from_previous": change_percent(now, before),
        "change_from_first": change_percent(now, first),
    })


def over_hourly_limit(scan_log: DataFrame, limit: int = fixed.SCANS_PER_HOUR) -> DataFrame:
    """Scans beyond ``limit`` within the hour before them, per user."""
    counted = trailing_count(scan_log, ["user_id"], F.unix_seconds("ts"), 3600, "in_last_hour")
    return counted.filter(F.col("in_last_hour") > limit)


# --- scanner notes -----------------------------------------------------------------------


def clean_note(text: Column) -> Column:
    """Without its tag, the first line that is not blank; a known failure gets plain words."""
    bare = F.regexp_replace(text, r"^\[[a-z-]+\]\s*", "")
    first = F.regexp_extract(bare, rf"[{fixed.WS}]*([^{fixed.WS}](?:[^\r\n]*[^{fixed.WS}])?)", 1)
    line = F.coalesce(F.nullif(first, F.lit("")), text)
    docker = line.contains(fixed.DOCKER_DOWN_MARKS[0]) | line.contains(fixed.DOCKER_DOWN_MARKS[1])
    return F.when(docker, F.lit(fixed.DOCKER_DOWN_NOTE)).otherwise(line)


def unique_notes(notes: DataFrame) -> DataFrame:
    """Notes by level and text, the first occurrence kept (``seq, level, text``)."""
    return notes.groupBy("level", "text").agg(F.min("seq").alias("seq"))
