"""Sinks and table stores."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators import history
from inkprint.session import work_folder

SNAPSHOT_SCHEMA = "target_key string, scan_ts timestamp, id string, severity string, folder string"


def write_findings(findings: DataFrame, path: str) -> None:
    """One JSON finding per line, in as many files as there are partitions."""
    findings.write.mode("overwrite").json(path)


def write_report_tables(summary: DataFrame, units: DataFrame, findings: DataFrame, path: str) -> None:
    """S8 at any size: the report as JSON tables side by side."""
    for name, table in (("summary", summary), ("units", units), ("findings", findings)):
        table.write.mode("overwrite").json(f"{path}/{name}")


def report_documents(units: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON document per path with its units and findings; the summary stands beside them.

    A document is as large as its file's report, whatever the size of the scan. A file without
    units or without findings has an empty list.
    """
    rows = lambda df, path, order: df.groupBy(F.col(path).alias("path")).agg(
        F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.struct("*").alias("row")))).alias("rows")
    ).select("path", F.col("rows.row").alias("rows"))
    per_unit = rows(units, "path", ("ordinal", "start_line", "id")).withColumnRenamed("rows", "units")
    per_finding = rows(findings, "file", ("line", "id")).withColumnRenamed("rows", "findings")
    both = per_unit.join(per_finding, "path", "full_outer")
    body = F.struct("path", *(F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("units", "findings")))
    return both.select("path", F.to_json(body).alias("report"))


class SnapshotStore:
    """The latest snapshot of every target, in a fixed number of buckets of targets.

    A snapshot is appended under a version of its own: its findings first, then one mark per target.
    The newest mark of a target tells which rows are its snapshot, so readers never see half a
    snapshot, a snapshot written twice counts once, and one without findings counts too. Nothing is
    listed per target, however many there are; a reader of one target reads its bucket only. What newer
    snapshots have replaced stays until `compact`. Writers take turns.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, target: Column) -> Column:
        return F.pmod(F.xxhash64(target), F.lit(self.buckets)).cast("int")

    def _table(self, part: str, columns: str) -> DataFrame:
        schema = f"{columns}, version string, bucket int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, part: str, version: str) -> None:
        placed = rows.withColumns({"version": F.lit(version), "bucket": self._bucket(F.col("target_key"))})
        placed.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{part}")

    def marks(self, before: str | None = None) -> DataFrame:
        """The scan of every target's snapshot (``target_key, scan_ts, version, bucket``), as it was before a version."""
        marks = self._table("marks", "target_key string, scan_ts timestamp")
        marks = marks if before is None else marks.filter(F.col("version") < before)
        newest = marks.groupBy("target_key", "bucket").agg(F.max(F.struct("version", "scan_ts")).alias("_newest"))
        return newest.select("target_key", "_newest.scan_ts", "_newest.version", "bucket")

    def read(self, before: str | None = None) -> DataFrame:
        """The findings of all snapshots."""
        chosen = self.marks(before).select("target_key", "version", "bucket")
        rows = self._table("rows", SNAPSHOT_SCHEMA).join(chosen, ["target_key", "version", "bucket"], "left_semi")
        return rows.select("target_key", "scan_ts", "id", "severity", "folder")

    def previous(self, target_key: str) -> DataFrame | None:
        """The stored snapshot of a target, or None for the first scan."""
        here = (F.col("target_key") == target_key) & (F.col("bucket") == self._bucket(F.lit(target_key)))
        newest = self._table("marks", "target_key string, scan_ts timestamp").filter(here).agg(F.max("version")).first()[0]
        if newest is None:
            return None
        rows = self._table("rows", SNAPSHOT_SCHEMA).filter(here & (F.col("version") == newest) & F.col("id").isNotNull())
        return rows.select("target_key", "scan_ts", "id", "severity", "folder")

    def replace(self, snapshot: DataFrame, target_key: str, scan_ts: Column) -> None:
        """Stores the snapshot of one target; an empty one counts."""
        scans = self.spark.range(1).select(F.lit(target_key).alias("target_key"), scan_ts.alias("scan_ts"))
        self.replace_all(snapshot.filter(F.col("target_key") == target_key), scans)

    def replace_all(self, snapshots: DataFrame, scans: DataFrame, version: str | None = None) -> None:
        """Stores the snapshots of all targets in ``scans`` (``target_key, scan_ts``); other targets keep theirs.

        Versions sort as text and are used once: a write that is repeated takes a newer one.
        """
        version = version or self.next_version()
        findings = snapshots.select("target_key", F.col("scan_ts").cast("timestamp").alias("scan_ts"), "id", "severity", "folder")
        self._append(findings, "rows", version)
        self._append(scans.select("target_key", F.col("scan_ts").cast("timestamp").alias("scan_ts")), "marks", version)

    @staticmethod
    def next_version() -> str:
        return f"{time.time_ns():020d}"

    def compact(self) -> None:
        """Rewrites the buckets without what has been replaced, each by one overwrite."""
        marks = self.marks()
        for part, rows in (("rows", self._table("rows", SNAPSHOT_SCHEMA).join(marks.select("target_key", "version", "bucket"), ["target_key", "version", "bucket"], "left_semi")), ("marks", marks)):
            staged = work_folder(self.spark, "compact")
            rows.write.parquet(staged)
            kept = self.spark.read.schema(rows.schema).parquet(staged)
            kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{part}")


def write_history(lines: DataFrame, path: str) -> None:
    """The kept history as text lines, oldest first (bounded by the retention)."""
    kept = history.retained_history(lines)
    kept.orderBy("seq").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_calibration(evaluations: DataFrame, counts: DataFrame, recommended: DataFrame, path: str) -> None:
    """The sweep, and one row with the corpus counts and the recommended threshold."""
    evaluations.write.mode("overwrite").json(f"{path}/evaluations")
    chosen = recommended.select(F.struct("*").alias("recommended"))
    counts.withColumn("recommended", chosen.scalar()).write.mode("overwrite").json(f"{path}/recommendation")
