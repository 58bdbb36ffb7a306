"""The scan: files to report, with the costly tables written once (lifecycle A, B and C)."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkprint.config import DEFAULT_CONFIG, ScanConfig
from inkprint.operators import attribute as at
from inkprint.operators import calibrate as cal
from inkprint.operators import delta as dl
from inkprint.operators import paths as pt
from inkprint.operators import report as rp
from inkprint.operators.findings import FINDING_COLUMNS, local_findings, without_suppressed
from inkprint.operators.registry import ScannerRegistry, default_registry
from inkprint.operators.score import explained, score_units, signal_array
from inkprint.operators.signals import SIGNAL_COLUMNS
from inkprint.operators.units import split_files, unit_id
from inkprint.session import work_folder
from inkprint.sources.tables import SnapshotStore

UNIT_COLUMNS = ("id", "path", "name", "kind", "start_line", "end_line", "ordinal", "code", "loc", "points",
                "score", "flagged", "band", *SIGNAL_COLUMNS)


@dataclass(frozen=True)
class Scan:
    """Tables of a finished scan. ``units`` and ``findings`` are Parquet tables in ``folder``."""

    folder: str
    units: DataFrame
    findings: DataFrame
    summary: DataFrame
    contributions: DataFrame
    delta: DataFrame | None
    folders: DataFrame | None
    scanners: DataFrame
    phases: Mapping[str, int]
    written: Mapping[str, int]

    def profile(self) -> DataFrame:
        """One row per phase, in order: rows it has written, milliseconds it took."""
        rows = [(place, phase, self.written.get(phase), spent) for place, (phase, spent) in enumerate(self.phases.items())]
        return self.units.sparkSession.createDataFrame(rows, "place int, phase string, rows bigint, millis bigint")

    def rows(self) -> DataFrame:
        return rp.report_rows(
            self.summary, self.contributions, self.delta, self.folders, self.findings, self.phases["total"]
        )


class _Phases:
    """Wall-clock milliseconds of each phase, and the rows it writes as Spark observes them."""

    def __init__(self) -> None:
        self.started = time.monotonic()
        self.spent: dict[str, int] = {}
        self.observed: dict[str, Observation] = {}

    def watch(self, phase: str, rows: DataFrame) -> DataFrame:
        """``rows``, counted while they are written: no pass of its own."""
        self.observed[phase] = Observation()
        return rows.observe(self.observed[phase], F.count(F.lit(1)).alias("rows"))

    def written(self) -> dict[str, int]:
        return {phase: seen.get["rows"] for phase, seen in self.observed.items()}

    def done(self, phase: str) -> None:
        now = time.monotonic()
        self.spent[phase] = int((now - self.started) * 1000)
        self.started = now

    def profile(self) -> dict[str, int]:
        return {**self.spent, "total": sum(self.spent.values())}


def score_table(units: DataFrame, config: ScanConfig = DEFAULT_CONFIG) -> DataFrame:
    """Scored units as they are stored: identity, signals, score, explanation."""
    scored = score_units(units, config)
    identity = unit_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name"))
    return scored.withColumns({
        "id": identity, "signals": signal_array(config), "explained": explained(),
    }).select(*UNIT_COLUMNS, "signals", "explained")


def configured_files(files: DataFrame, config: ScanConfig, root: str = "/") -> DataFrame:
    """The files the configuration leaves: not excluded; those above the size limit are ``skipped`` and lose their content."""
    files = files.filter(~pt.is_excluded(F.col("path"), config.exclude, root))
    if "content" not in files.columns:
        return files
    large = F.coalesce(F.octet_length("content") > config.max_file_size, F.lit(False))
    files = files.withColumn("status", F.when(large, "skipped").otherwise(F.col("status") if "status" in files.columns else F.lit("scanned")))
    return files.withColumn("content", F.when(~large, F.col("content")))


def run_scan(
    spark: SparkSession,
    files: DataFrame,
    config: ScanConfig = DEFAULT_CONFIG,
    *,
    units: DataFrame | None = None,
    scanner_inputs: Mapping[str, DataFrame] | None = None,
    registry: ScannerRegistry | None = None,
    root: str = "/",
    target_key: str | None = None,
    snapshots: SnapshotStore | None = None,
    suppressions: DataFrame | None = None,
    folder: str | None = None,
) -> Scan:
    """Scans ``files`` (``path, content`` and optionally ``status``), or given ``units`` of them.

    Scored units and attributed findings are written once and read by everything after; the
    report, the contributions and the delta are small aggregations over those tables.
    """
    phases = _Phases()
    folder = folder or work_folder(spark, "scan")
    files = configured_files(files, config, root)
    if units is None:
        units = split_files(files)
    phases.watch("scoring", score_table(units, config)).write.mode("overwrite").parquet(f"{folder}/units")
    scored = spark.read.parquet(f"{folder}/units")
    phases.done("scoring")

    parts = [local_findings(scored, config).select(*FINDING_COLUMNS)]
    external, status = (registry or default_registry()).run_isolated(spark, scanner_inputs or {}, root, config, f"{folder}/scanners")
    if external is not None:
        parts.append(at.attribute(external, scored, config).select(*FINDING_COLUMNS))
    findings = reduce(DataFrame.unionByName, parts)
    if suppressions is not None:
        findings = without_suppressed(findings, suppressions)
    phases.watch("securityAnalysis", findings.select(*FINDING_COLUMNS)).write.mode("overwrite").parquet(f"{folder}/findings")
    findings = spark.read.parquet(f"{folder}/findings")
    phases.done("securityAnalysis")

    summary = rp.summarize(scored, findings, files, config)
    phases.watch("reportGeneration", summary).write.mode("overwrite").parquet(f"{folder}/summary")
    summary = spark.read.parquet(f"{folder}/summary")
    contributions = rp.weighted_contributions(scored, config)
    delta = folders = None
    if snapshots is not None and target_key is not None:
        now = F.current_timestamp()
        current = dl.snapshot(findings, target_key, now, root)
        previous = snapshots.previous(target_key)
        dl.delta_summary(current, previous).write.mode("overwrite").parquet(f"{folder}/delta")
        if previous is not None:
            dl.folder_movement(current, previous).write.mode("overwrite").parquet(f"{folder}/folders")
            folders = spark.read.parquet(f"{folder}/folders")
        delta = spark.read.parquet(f"{folder}/delta")
        snapshots.replace(current, target_key, now)
    phases.done("reportGeneration")
    return Scan(folder, scored, findings, summary, contributions, delta, folders, status, phases.profile(), phases.written())


def run_check(spark: SparkSession, files: DataFrame, changed: DataFrame, config: ScanConfig = DEFAULT_CONFIG, **options) -> Scan:
    """The scan of the changed files only (``changed``: ``path``), or of changed line ranges.

    With ``first_line`` and ``last_line`` in ``changed``, units no range touches are left out.
    """
    touched = files.join(changed.select("path").distinct(), "path", "left_semi")
    units = None
    if "first_line" in changed.columns:
        units = at.changed_units(split_files(touched), changed)
    return run_scan(spark, touched, config, units=units, **options)


def run_calibration(
    labelled_units: DataFrame,
    config: ScanConfig = DEFAULT_CONFIG,
    target_precision: float = cal.TARGET_PRECISION,
    min_recall: float = cal.MIN_RECALL,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluations, corpus counts and the recommended threshold of labelled units.

    ``labelled_units``: a unit table with ``path`` and ``label``. The samples are written once.
    """
    spark = labelled_units.sparkSession
    place = work_folder(spark, "samples")
    cal.sample_scores(score_units(labelled_units, config)).write.parquet(place)
    samples = spark.read.parquet(place)
    evaluations = cal.sweep(samples)
    return evaluations, cal.corpus_counts(samples), cal.best_threshold(evaluations, target_precision, min_recall)
