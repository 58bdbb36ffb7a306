"""Comparison of scans.

A snapshot is a table ``target_key, scan_ts, id, severity, folder``. Counts are made by one
aggregation over both snapshots tagged by side. It combines before the shuffle, so an id that
fills a third of a snapshot arrives as one row per task, and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.functions.scalars import folder_of, severity_risk
from inkprint.operators.ordering import with_previous

TOP_FOLDERS = 3


def snapshot(findings: DataFrame, target_key: str, scan_ts: Column, root: str = "") -> DataFrame:
    return findings.select(
        F.lit(target_key).alias("target_key"), scan_ts.alias("scan_ts"), "id", "severity",
        folder_of(F.col("file"), root).alias("folder"),
    )


def new_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current rows whose id the previous snapshot lacks; repeats are kept.

    The ids are not made distinct first: both sides are then plain shuffles, and adaptive execution
    can split an id that fills a large part of a snapshot.
    """
    return current.join(previous.select("id"), "id", "left_anti")


def resolved_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    return new_findings(previous, current)


def risk_score(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.sum(severity_risk(F.col("severity"))), F.lit(0)).cast("bigint").alias("risk"))


def folder_risk(findings: DataFrame) -> DataFrame:
    return findings.groupBy("folder").agg(F.sum(severity_risk(F.col("severity"))).cast("bigint").alias("risk"))


def _sides(current: DataFrame, previous: DataFrame | None, *columns: str) -> DataFrame:
    tagged = current.select(*columns, F.lit(True).alias("is_current"))
    if previous is None:
        return tagged
    return tagged.unionByName(previous.select(*columns, F.lit(False).alias("is_current")))


def _per_id(facts: DataFrame, *keys: str) -> DataFrame:
    """Per id: rows, risk and rows by severity on each side."""
    now, sev = F.col("is_current"), F.col("severity")
    counted = {"now_n": F.count_if(now & F.col("id").isNotNull()), "old_n": F.count_if(~now)}
    counted["now_risk"] = F.sum(F.when(now, severity_risk(sev)))
    counted["old_risk"] = F.sum(F.when(~now, severity_risk(sev)))
    for s in fixed.SEVERITIES:
        counted[f"now_{s}"] = F.count_if(now & (sev == s))
        counted[f"old_{s}"] = F.count_if(~now & (sev == s))
    return facts.groupBy(*keys, "id").agg(*[column.alias(name) for name, column in counted.items()])


def _totals() -> list[Column]:
    is_new = F.col("old_n") == 0
    is_gone = F.col("now_n") == 0
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
    columns = [
        total("now_risk").alias("risk_current"),
        total("old_risk").alias("risk_previous"),
        total("now_n").alias("findings_current"),
        total("old_n").alias("findings_previous"),
        total(F.when(is_new, F.col("now_n"))).alias("new_findings"),
        total(F.when(is_gone, F.col("old_n"))).alias("resolved_findings"),
    ]
    for s in fixed.SEVERITIES:
        columns.append(total(F.when(is_new, F.col(f"now_{s}"))).alias(f"new_{s.lower()}"))
        columns.append(total(F.when(is_gone, F.col(f"old_{s}"))).alias(f"resolved_{s.lower()}"))
    return columns


def _with_changes(totals: DataFrame, baseline: Column) -> DataFrame:
    changed = totals.withColumns({
        "baseline": baseline,
        "risk_change": F.col("risk_current") - F.col("risk_previous"),
        "findings_change": F.col("findings_current") - F.col("findings_previous"),
    })
    worse = (F.col("risk_change") >= fixed.REGRESSION_RISK_CHANGE) | (F.col("new_critical") > 0)
    return changed.withColumn("regression_alert", ~F.col("baseline") & worse)


def delta_summary(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """One row. Without a previous snapshot it is the baseline, which never alerts."""
    totals = _per_id(_sides(current, previous, "id", "severity")).agg(*_totals())
    return _with_changes(totals, F.lit(previous is None))


def folder_changes(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Risk of every folder on both sides."""
    risk = severity_risk(F.col("severity"))
    now = F.col("is_current")
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
    return (
        _sides(current, previous, "folder", "severity")
        .groupBy("folder")
        .agg(
            total(F.when(now, risk)).alias("current_risk"),
            total(F.when(~now, risk)).alias("previous_risk"),
            F.max(now).alias("in_current"),
        )
        .withColumn("change", F.col("current_risk") - F.col("previous_risk"))
    )


def folder_movement(current: DataFrame, previous: DataFrame | None, limit: int = TOP_FOLDERS) -> DataFrame:
    """The folders that moved most; on ties present ones first, then by name."""
    moved = folder_changes(current, previous).filter("change <> 0")
    ranked = moved.orderBy(F.abs("change").desc(), F.col("in_current").desc(), "folder").limit(limit)
    return ranked.drop("in_current")


def delta_series(snapshots: DataFrame, scans: DataFrame) -> DataFrame:
    """The delta of every scan of a target against the scan before it.

    ``scans``: all scans (``target_key, scan_ts``), also those without a finding. Each finding
    is counted at its own scan and, as the past, at the next one.
    """
    chain = with_previous(scans.distinct(), ["target_key"], ["scan_ts"], ["scan_ts"])
    rows = snapshots.select("target_key", "scan_ts", "id", "severity")
    markers = chain.select(
        "target_key", "scan_ts", F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("severity"), F.lit(True).alias("is_current"),
    )
    following = chain.filter(F.col("prev_scan_ts").isNotNull()).select(
        "target_key", F.col("prev_scan_ts").alias("at"), F.col("scan_ts").alias("next_ts")
    )
    past = (
        rows.withColumnRenamed("scan_ts", "at").join(following, ["target_key", "at"])
        .select("target_key", F.col("next_ts").alias("scan_ts"), "id", "severity", F.lit(False).alias("is_current"))
    )
    facts = markers.unionByName(rows.withColumn("is_current", F.lit(True))).unionByName(past)
    per_scan = _per_id(facts, "target_key", "scan_ts").groupBy("target_key", "scan_ts").agg(*_totals())
    starts = chain.select("target_key", "scan_ts", F.col("prev_scan_ts").isNull().alias("_first"))
    joined = per_scan.join(starts, ["target_key", "scan_ts"])
    return _with_changes(joined, F.col("_first")).drop("_first")
