"""Streams that tell what is still open at their end."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkprint.operators import accounts as ac
from inkprint.sources.tables import SnapshotStore
from inkprint.streaming import jobs, sinks
from inkprint.streaming.lockout import lock_events


def test_the_last_sessions_and_locks_are_told(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(minutes=m), m, False) for u in (1, 2) for m in (*range(5), *range(3000, 3006))]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp, seq long, ok boolean").coalesce(1)
    frame.write.parquet(str(tmp_path / "in"))
    last = frame.agg(F.max("ts")).first()[0]
    stream = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    locks = sinks.append_to_the_end(stream(), lock_events, "locks", last, "2 hours").collect()
    assert sorted(map(tuple, locks)) == sorted((r["user_id"], r["locked_at_us"]) for r in ac.lockouts(frame).collect()) and len(locks) == 4
    history = stream().select(F.col("user_id").alias("target"), "ts")
    made = sinks.append_to_the_end(history, lambda e: jobs.target_sessions(e, "1 hour", "12 hours"), "sessions", last, "14 hours")
    assert sorted((r["target"], r["scans"]) for r in made.collect()) == [(1, 5), (1, 6), (2, 5), (2, 6)]


def _arrive(spark, folder, rows):
    """Findings (target, day, id, severity) and closing rows (target, day, number)."""
    full = [(r[0], datetime(2024, 1, r[1]), *((r[2], r[3], "src", None) if len(r) == 4 else (None, None, None, r[2]))) for r in rows]
    spark.createDataFrame(full, jobs.ARRIVING).write.mode("append").parquet(folder)


def test_scans_are_compared_when_they_are_whole(spark, tmp_path):
    source, store = str(tmp_path / "in"), SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    _arrive(spark, source, [])

    def step(*rows):
        _arrive(spark, source, rows)
        stream = spark.readStream.schema(jobs.ARRIVING).parquet(source)
        told = jobs.delta_per_scan(stream, store, str(tmp_path / "run")).collect()
        return {(r["target_key"], r["scan_ts"].day): (r["baseline"], r["new_findings"], r["resolved_findings"], r["regression_alert"]) for r in told}

    # two scans at once; the end of the first is known before its rows
    assert step(("a", 1, 2), ("a", 1, "x", "LOW"), ("b", 1, "p", "HIGH"), ("b", 2, "p", "HIGH")) == {}
    assert step(("b", 1, 1), ("c", 5, 0)) == {("b", 1): (True, 1, 0, False), ("c", 5): (True, 0, 0, False)}
    after = step(("a", 1, "y", "LOW"), ("a", 2, "y", "LOW"), ("a", 2, "z", "CRITICAL"), ("a", 2, 2), ("b", 2, 1))
    assert after[("a", 1)] == (True, 2, 0, False) and after[("a", 2)] == (False, 1, 1, True) and after[("b", 2)] == (False, 0, 0, False)
    assert {r["id"] for r in store.previous("a").collect()} == {"y", "z"} and store.previous("c").count() == 0
    # an earlier scan that is late is told and replaces nothing, an empty one resolves all
    late = step(("b", 1, "late", "LOW"), ("a", 3, 0))
    assert len(late) == 6 and late[("a", 3)] == (False, 0, 2, False) and store.previous("a").count() == 0
    late = step(("c", 4, "q", "LOW"), ("c", 4, 1))
    assert late[("c", 4)] == (True, 1, 0, False) and store.previous("c").count() == 0


def test_a_repeated_batch_sees_the_store_as_it_was(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    rows = lambda *ids: spark.createDataFrame([("t", datetime(2024, 1, 1), i, "LOW", "src") for i in ids], "target_key string, scan_ts timestamp, id string, severity string, folder string")
    store.replace(rows("a"), "t", F.lit("2024-01-01").cast("timestamp"))
    version = store.next_version()
    store.replace(rows("b", "c"), "t", F.lit("2024-01-02").cast("timestamp"))
    assert [r["id"] for r in store.read(before=version).collect()] == ["a"]
    # rows whose mark was never written are no snapshot
    store._append(rows("torn"), "rows", store.next_version())
    assert {r["id"] for r in store.read().collect()} == {"b", "c"} == {r["id"] for r in store.previous("t").collect()}
    store.compact()
    assert {r["id"] for r in store.read().collect()} == {"b", "c"}
    assert spark.read.parquet(str(tmp_path / "store" / "rows")).count() == 2


def test_targets_make_no_folders(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    targets = spark.range(100_000).select(F.concat(F.lit("t"), "id").alias("target_key"), F.lit("2024-01-01").cast("timestamp").alias("scan_ts"))
    store.replace_all(targets.select("*", F.lit("i").alias("id"), F.lit("LOW").alias("severity"), F.lit("").alias("folder")), targets)
    assert len([p for p in (tmp_path / "store" / "rows").iterdir() if p.is_dir()]) == 4
    assert store.read().count() == 100_000 and store.previous("t77").count() == 1
