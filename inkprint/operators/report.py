"""Report aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.config import DEFAULT_CONFIG, ScanConfig
from inkprint.functions.scalars import half_up, one_decimal, severity_risk, signed
from inkprint.operators.findings import local_matches, local_severity
from inkprint.operators.signals import SIGNALS

TOP_CONTRIBUTIONS = 8
BAR_WIDTH = 16
_MEASURES = (
    "units", "flagged", "score_sum", "loc",
    *(f"band_{b.lower()}" for b in fixed.BANDS), *(s.lower() for s in fixed.SEVERITIES),
)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Four counts, zero where a severity does not occur, and their total."""
    return findings.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in fixed.SEVERITIES],
        F.count("*").alias("total"),
    )


def _measures(**given: Column) -> list[Column]:
    return [given.get(m, F.lit(0)).cast("bigint").alias(m) for m in _MEASURES]


def _by_severity(severity: Column) -> dict[str, Column]:
    return {s.lower(): F.coalesce(severity == s, F.lit(False)).cast("int") for s in fixed.SEVERITIES}


def report_summary(
    scored: DataFrame,
    config: ScanConfig = DEFAULT_CONFIG,
    external: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """The summary row of a scan straight from scored units.

    Units and the findings inside them are measured in one pass over the scored units: the
    matches are exploded with their position, and the first row of a unit carries the unit's
    own measures. ``external`` findings may name files no unit is in; ``files`` may bring
    paths without units and a ``status``.
    """
    matched = scored.select(
        "path", "loc", "score", "flagged", "band", F.posexplode_outer(local_matches(config)).alias("no", "found")
    )
    first = (F.coalesce(F.col("no"), F.lit(0)) == 0).cast("int")
    severity = F.when(
        F.col("found").isNotNull(), local_severity(F.col("found.detector"), F.col("score"))
    )
    parts = [matched.select("path", *_measures(**_of_unit(first), **_by_severity(severity)))]
    if external is not None:
        parts.append(_finding_measures(external))
    return _totalled(parts, files, config)


def summarize(
    scored: DataFrame, findings: DataFrame, files: DataFrame | None = None, config: ScanConfig = DEFAULT_CONFIG
) -> DataFrame:
    """The summary row from stored units and findings."""
    parts = [scored.select("path", *_measures(**_of_unit(F.lit(1)))), _finding_measures(findings)]
    return _totalled(parts, files, config)


def _of_unit(weight: Column) -> dict[str, Column]:
    return {
        "units": weight,
        "flagged": weight * F.col("flagged").cast("int"),
        "score_sum": weight * F.col("score"),
        "loc": weight * F.col("loc"),
        **{f"band_{b.lower()}": weight * (F.col("band") == b).cast("int") for b in fixed.BANDS},
    }


def _finding_measures(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("file").alias("path"), *_measures(**_by_severity(F.col("severity"))))


def _totalled(parts: list[DataFrame], files: DataFrame | None, config: ScanConfig) -> DataFrame:
    """Measures summed per path before the shuffle; the number of paths is the number of files,
    those known only from a finding included."""
    skipped = None
    if files is not None:
        if "status" in files.columns:
            skipped = files.agg(F.count_if(F.col("status") == "skipped").alias("skipped_files")).scalar()
            files = files.filter("status = 'scanned'")
        parts = [*parts, files.select("path", *_measures())]
    per_file = reduce(DataFrame.unionByName, parts).groupBy("path").agg(*[F.sum(m).alias(m) for m in _MEASURES])
    totals = per_file.agg(
        F.count("*").alias("files_scanned"),
        *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in _MEASURES],
    )
    none = F.lit(0).cast("bigint")
    return _finished(totals.withColumn("skipped_files", none if skipped is None else skipped), config)


def _finished(totals: DataFrame, config: ScanConfig) -> DataFrame:
    at_least_one = lambda c: F.greatest(F.lit(1), F.col(c))
    per_k = lambda n, loc: one_decimal(n / loc * 1000)
    findings = sum((F.col(s.lower()) for s in fixed.SEVERITIES), F.lit(0))
    blocking = sum((F.col(s.lower()) for s in config.block_on), F.lit(0))
    ratio = F.col("flagged") / at_least_one("units")
    summary = totals.select(
        "files_scanned", "skipped_files",
        F.col("units").alias("total_units"),
        F.col("flagged").alias("flagged_units"),
        F.col("loc").alias("total_loc"),
        *[F.col(s.lower()) for s in fixed.SEVERITIES],
        findings.cast("bigint").alias("findings"),
        (blocking > 0).alias("blocked"),
        half_up(F.col("score_sum") / at_least_one("units")).alias("ai_score"),
        ratio.alias("flag_ratio"),
        half_up(ratio * 100).alias("ai_percentage"),
        per_k(F.col("critical"), at_least_one("loc")).alias("critical_per_1k_loc"),
        per_k(findings, at_least_one("loc")).alias("findings_per_1k_loc"),
        *[F.col(f"band_{b.lower()}") for b in fixed.BANDS],
        F.lit(config.threshold).alias("threshold"),
    )
    return summary.withColumns({
        "score_relation": score_relation(F.col("ai_score"), F.col("threshold")),
        "gate_reason": gate_reason(F.col("blocked"), F.col("findings"), F.col("ai_score"), F.col("threshold")),
    })


def score_relation(score: Column, threshold: Column) -> Column:
    return (
        F.when(threshold.isNull(), "threshold unavailable")
        .when(score == threshold, "at threshold")
        .when(score < threshold, "below threshold")
        .otherwise("above threshold")
    )


def gate_reason(blocked: Column, findings: Column, score: Column, threshold: Column) -> Column:
    relation = score_relation(score, threshold)
    return (
        F.when(blocked & (findings > 0), F.lit("blocked (security findings matched block policy)"))
        .when(blocked, F.concat(F.lit("blocked (ai score "), relation, F.lit(")")))
        .when(findings == 0, F.concat(F.lit("pass (no security findings, ai score "), relation, F.lit(")")))
        .otherwise(F.concat(
            F.lit("pass (security findings present but below block policy, ai score "), relation, F.lit(")")
        ))
    )


def weighted_contributions(
    scored: DataFrame, config: ScanConfig = DEFAULT_CONFIG, limit: int = TOP_CONTRIBUTIONS
) -> DataFrame:
    """The signals that carry most of all points; ties keep the signal order.

    Thirteen sums in one aggregation, turned into rows afterwards: units are not multiplied.
    """
    sums = scored.agg(*[F.coalesce(F.sum(s.column), F.lit(0)).alias(s.column) for s in SIGNALS], F.count("*").alias("n"))
    total = sum((F.col(s.column) for s in SIGNALS), F.lit(0))
    rows = sums.select(
        total.alias("total"),
        F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("place"), F.lit(s.name).alias("signal"),
                F.col(s.column).cast("bigint").alias("score"),
                (F.col("n") * config.weights[s.name]).alias("max_weight"),
            )
            for i, s in enumerate(SIGNALS)
        ])),
    ).filter("max_weight > 0 OR score > 0")
    share = F.when(F.col("total") == 0, F.lit(0)).otherwise(half_up(F.col("score") / F.col("total") * 100))
    return (
        rows.orderBy(F.col("score").desc(), "place").limit(limit)
        .select("signal", share.cast("bigint").alias("contribution"), "score", "max_weight")
    )


def severity_shares(findings: DataFrame) -> DataFrame:
    """Width of each severity in a bar of sixteen; absent severities have no row."""
    counts = severity_counts(findings)
    rows = counts.select(
        "total",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("place"), F.lit(s).alias("severity"), F.col(s.lower()).alias("n"))
            for i, s in enumerate(fixed.SEVERITIES)
        ])),
    )
    width = F.greatest(F.lit(2).cast("bigint"), half_up(F.col("n") / F.col("total") * BAR_WIDTH))
    return rows.filter("n > 0").select("place", "severity", F.col("n").alias("findings"), width.alias("width"))


def critical_per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file").agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count("*").alias("findings")
    )


def risk_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file").agg(F.sum(severity_risk(F.col("severity"))).cast("bigint").alias("risk"))


def parse_max_findings(raw: str | None) -> int | None:
    """Number of findings to show; None for all."""
    if raw is None or raw in ("", "all"):
        return None
    try:
        value = float(raw)
    except ValueError:
        return None
    return int(value) if 0 < value < float("inf") else None


def first_findings(findings: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first findings in report order, or all."""
    return findings if limit is None else findings.orderBy(*order).limit(limit)


def plain_number(n: Column) -> Column:
    """One decimal where there is one, none otherwise."""
    return F.regexp_replace(F.format_string("%.1f", n), r"\.0$", "")


def report_rows(
    summary: DataFrame, contributions: DataFrame, delta: DataFrame | None = None, folders: DataFrame | None = None,
    findings: DataFrame | None = None, duration_ms: int | None = None,
) -> DataFrame:
    """The values of the text report as (place, section, label, value) rows.

    ``folders`` is the folder movement of the delta, ``findings`` give the severity bar.
    """
    text = lambda c: F.col(c).cast("string")
    percent = lambda c: F.concat(text(c), F.lit("%"))
    context = F.lit("")
    if delta is not None:
        since = F.concat(F.lit(", "), signed(F.col("new_high") + F.col("new_critical")), F.lit(" high-risk vs last run"))
        context = delta.select(F.when(F.col("baseline"), "").otherwise(since)).scalar()
    entries = [
        ("metrics", "files", text("files_scanned")),
        ("metrics", "units", text("total_units")),
        ("metrics", "ai-flagged units", text("flagged_units")),
        ("metrics", "AI score", F.concat(text("ai_score"), F.lit("/100"))),
        ("metrics", "AI%", percent("ai_percentage")),
        ("metrics", "risk", F.concat(plain_number(F.col("findings_per_1k_loc")), F.lit("/1k LOC"))),
        ("metrics", "gate", F.when(F.col("blocked"), "blocked").otherwise("pass")),
        ("metrics", "gate reason", F.concat(F.col("gate_reason"), context)),
        ("ai-origin", "score", F.concat(text("ai_score"), F.lit("/100"))),
        ("ai-origin", "flagged units", text("flagged_units")),
        ("ai-origin", "ratio", percent("ai_percentage")),
        ("ai-origin", "threshold", text("threshold")),
        *[("security", s.lower(), text(s.lower())) for s in fixed.SEVERITIES],
        *[("bands", b, text(f"band_{b.lower()}")) for b in fixed.BANDS],
    ]
    if duration_ms is not None:
        entries.append(("metrics", "duration", F.lit(f"{duration_ms}ms")))
    rows = _as_rows(summary, entries, 0)
    order = F.array_position(F.array(*[F.lit(s.name) for s in SIGNALS]), F.col("signal"))
    ranked = F.struct((-F.col("score")).alias("score"), order.alias("at"), "signal", "contribution")
    top = contributions.agg(F.slice(F.sort_array(F.collect_list(ranked)), 1, 4).alias("top")).select(F.posexplode("top").alias("i", "t"))
    rows = rows.unionByName(top.select(
        (F.col("i") + 100).alias("place"), F.lit("top signals").alias("section"), F.col("t.signal").alias("label"),
        F.concat(F.col("t.contribution").cast("string"), F.lit("%")).alias("value"),
    ))
    if delta is not None:
        change = lambda value: F.when(~F.col("baseline"), value)
        rows = rows.unionByName(_as_rows(delta, [
            ("delta", "new", change(text("new_findings"))),
            ("delta", "resolved", change(text("resolved_findings"))),
            ("delta", "risk delta", change(signed(F.col("risk_change")))),
            ("delta", "alert", change(F.when(F.col("regression_alert"), "regression").otherwise("stable"))),
            ("delta", "baseline", F.when(F.col("baseline"), fixed.BASELINE_NOTE)),
        ], 200).filter("value IS NOT NULL"))
    if folders is not None:
        moved = F.struct((-F.abs("change")).alias("by"), "folder", F.concat("folder", F.lit(":"), signed(F.col("change"))).alias("text"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(moved)), lambda m: m["text"]), "   ")
        movement = folders.agg(F.nullif(joined, F.lit("")).alias("moved"))
        rows = rows.unionByName(_as_rows(movement, [("delta", "folder movement", F.col("moved"))], 300).filter("value IS NOT NULL"))
    if findings is not None:
        rows = rows.unionByName(severity_shares(findings).select(
            (F.col("place") + 400).alias("place"), F.lit("severity").alias("section"), F.col("severity").alias("label"),
            F.col("width").cast("string").alias("value"),
        ))
    return rows


def _as_rows(row: DataFrame, entries: list[tuple[str, str, Column]], offset: int) -> DataFrame:
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(offset + i).alias("place"), F.lit(section).alias("section"), F.lit(label).alias("label"),
            value.alias("value"),
        )
        for i, (section, label, value) in enumerate(entries)
    ])))


def dashboard_totals(scans: DataFrame) -> DataFrame:
    return scans.agg(*[
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("critical", "high", "flagged_units")
    ])
