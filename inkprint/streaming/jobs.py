"""Streaming forms of the engine (ST1-ST5, ST7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.config import DEFAULT_CONFIG, ScanConfig
from inkprint.operators import delta as dl
from inkprint.operators.score import score_units
from inkprint.sources.tables import SNAPSHOT_SCHEMA, SnapshotStore
from inkprint.streaming.sinks import each_batch, run_batches

FINISHED = ("scanned", "skipped", "missing")


def progress_fold(events: DataFrame) -> DataFrame:
    """ST1: per scan the last finished index, the latest total and all findings so far.

    ``events``: ``scan_id, seq, index, total, status, findings``.
    """
    done = F.col("status").isin(*FINISHED)
    return events.groupBy("scan_id").agg(
        F.max_by(F.when(done, F.col("index")), F.when(done, F.col("seq"))).alias("processed"),
        F.max_by("total", "seq").alias("total"),
        F.sum(F.when(F.col("status") == "scanned", F.col("findings")).otherwise(0)).alias("findings"),
    )


def scored_stream(units: DataFrame, config: ScanConfig = DEFAULT_CONFIG) -> DataFrame:
    """ST2: units scored as they arrive. The signals are row-wise, so no state is kept."""
    return score_units(units, config)


def finding_rate(findings: DataFrame, lateness: str, width: str, slide: str | None = None) -> DataFrame:
    """ST3: findings per severity and window of event time."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        findings.withWatermark("ts", lateness)
        .groupBy(window.alias("w"), "severity")
        .agg(F.count("*").alias("findings"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "severity", "findings")
    )


def delta_on_arrival(findings: DataFrame, previous: DataFrame | None, purpose: str) -> DataFrame:
    """ST4: the scan that arrives against the stored snapshot, in however many batches it comes.

    A batch is part of a scan: what it lacks may still come. So batches are only collected (a
    repeated batch replaces its own folder), and the comparison is made once the stream has ended.
    """
    narrow = findings.select("id", "severity")

    def write(batch: DataFrame, place: str) -> None:
        batch.write.mode("overwrite").parquet(place)

    rows = each_batch(narrow, purpose, write, mode="append")
    arrived = findings.sparkSession.read.schema(narrow.schema).option("recursiveFileLookup", "true").parquet(rows)
    return dl.delta_summary(arrived, previous)


ARRIVING = f"{SNAPSHOT_SCHEMA}, expected bigint"


def delta_per_scan(findings: DataFrame, store: SnapshotStore, folder: str) -> DataFrame:
    """ST4: the delta of each scan as soon as it is whole, any number of scans at once, in any order of rows.

    ``findings``: the columns of ARRIVING; a scan (target and time) is closed by a row with the number of
    its findings in ``expected`` and nothing in ``id``, severity and folder, which may come before them.
    Whole scans are compared with the target's stored snapshot, and with each other in the order of
    their times if several of a target become whole in one batch; the latest then replaces the
    snapshot. A scan that becomes whole after a later one of its target is told as a baseline and
    replaces nothing.

    Runs over what is there and returns all deltas so far; called again with the same folder, it goes on.
    A batch carries the rows of open scans to the next one, so its work grows with open scans and not
    with what has been. A repeated batch does as it did before: it sees the store as of the version it
    began with, and what it wrote itself is newer.
    """
    spark = findings.sparkSession
    scan = ["target_key", "scan_ts"]

    def write(batch: DataFrame, number: int) -> None:
        place = lambda part, n=number: f"{folder}/{part}/batch={n}"

        def kept(df: DataFrame, part: str) -> DataFrame:
            df.write.mode("overwrite").parquet(place(part))
            return spark.read.schema(df.schema).parquet(place(part))

        # the version is drawn once per batch, the first try's holds
        versions = spark.createDataFrame([(store.next_version(),)], "version string")
        versions.write.mode("ignore").parquet(place("version"))
        version = spark.read.parquet(place("version")).first()[0]
        arrived = batch.select(*findings.columns)
        if number:
            arrived = arrived.unionByName(spark.read.schema(ARRIVING).parquet(place("open", number - 1)))
        held = kept(arrived, "held")
        found = held.filter("expected IS NULL").drop("expected")
        counted = held.groupBy(*scan).agg(F.count_if(F.col("expected").isNull()).alias("n"), F.max("expected").alias("expected"))
        whole = kept(counted.filter("n >= expected").select(*scan), "whole")
        kept(held.join(whole, scan, "left_anti"), "open")
        rows = found.join(whole, scan, "left_semi")
        touched = whole.select("target_key").distinct()
        stored = store.marks(before=version).select(*scan).join(touched, "target_key", "left_semi")
        past = store.read(before=version).join(touched, "target_key", "left_semi")
        series = dl.delta_series(rows.unionByName(past.select(*rows.columns)), whole.unionByName(stored))
        kept(series.join(whole, scan, "left_semi"), "deltas")
        latest = whole.groupBy("target_key").agg(F.max("scan_ts").alias("scan_ts"))
        newer = stored.withColumnRenamed("scan_ts", "stored_ts")
        replacing = latest.join(newer, "target_key", "left").filter("stored_ts IS NULL OR scan_ts > stored_ts").select(*scan)
        # a repeated batch writes again under a newer version, below that of the next batch
        store.replace_all(rows.join(replacing, scan, "left_semi"), replacing, store.next_version())

    run_batches(findings, folder, write, "append")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/deltas")


def unique_findings(findings: DataFrame, lateness: str) -> DataFrame:
    """ST5: each finding once. The id repeats within a unit, so the match number is part of the key."""
    return findings.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id", "match_no"])


def target_sessions(history: DataFrame, lateness: str, gap: str) -> DataFrame:
    """ST7: runs of activity per target; append mode emits a session once it is over."""
    return (
        history.withWatermark("ts", lateness)
        .groupBy("target", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("scans"))
        .select("target", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "scans")
    )
