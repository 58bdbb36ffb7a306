"""Skew-safe forms against brute force, and plans that have to keep their shape."""

import random

import pytest
from pyspark.sql import functions as F

from inkprint.operators import accounts as ac
from inkprint.operators import attribute as at
from inkprint.operators import calibrate as cal
from inkprint.operators import delta as dl
from inkprint.operators import ordering as od
from inkprint.plans.queries import QUERIES

RNG = random.Random(7)


def skewed_key():
    return "hot" if RNG.random() < 0.4 else f"k{RNG.randrange(6)}"


def timeline(n=400, span=20_000):
    return [(skewed_key(), RNG.randrange(span), i, RNG.randrange(50)) for i in range(n)]


def test_previous_position_first(spark):
    rows = timeline()
    df = spark.createDataFrame(rows, "k string, t bigint, seq bigint, v bigint")
    slice_of = F.floor(F.col("t") / 500)
    out = od.with_previous(df, ["k"], ["t", "seq"], ["v"], slice_of)
    out = od.with_position(out, ["k"], ["t", "seq"], slice_of)
    out = od.with_first(out, ["k"], ["t", "seq"], ["v"])
    got = {r["seq"]: (r["prev_v"], r["position"], r["first_v"]) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(ordered):
            want[r[2]] = (ordered[i - 1][3] if i else None, i + 1, ordered[0][3])
    assert got == want


@pytest.fixture
def many_slices(spark):
    """As on a cluster: more ranges than rows would need."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_slices_hold_equal_rows(spark, many_slices):
    """60 of 100 rows are of one key and one day, and still no slice has more than twice the median."""
    rows = [("hot" if i % 10 < 6 else f"k{i % 7}", 5 if i % 10 < 6 else i % 90, i, RNG.randrange(50)) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, t bigint, seq bigint, v bigint")
    counts = sorted(r["count"] for r in od.row_slices(df, ["k"], ["t", "seq"]).groupBy("_slice").count().collect())
    assert len(counts) == 9 and counts[-1] < 2 * counts[4]


@pytest.mark.parametrize("how,inclusive", [("max", True), ("max", False), ("last", True), ("last", False)])
def test_running_over_slices(spark, many_slices, how, inclusive):
    rows = [(k, t, i, v if RNG.random() < 0.3 else None) for k, t, i, v in timeline(600)]
    df = spark.createDataFrame(rows, "k string, t bigint, seq bigint, v bigint")
    out = od.with_running(df, ["k"], ["t", "seq"], "v", "r", how, inclusive)
    out = od.with_position(od.with_previous(out, ["k"], ["t", "seq"], ["v"]), ["k"], ["t", "seq"])
    got = {r["seq"]: (r["r"], r["prev_v"], r["position"]) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(ordered):
            seen = [o[3] for o in ordered[: i + inclusive] if o[3] is not None]
            want[r[2]] = ((max(seen) if how == "max" else seen[-1]) if seen else None, ordered[i - 1][3] if i else None, i + 1)
    assert got == want


def test_long_units_are_in_few_blocks(spark):
    ranges = [(1, 10_000_000), (0, 0), (127, 128), (128, 255), (5, 4), (16_000, 40_000), (2_097_152, 4_194_303), (1, 127), (300, 900_000)]
    df = spark.createDataFrame(ranges, "a bigint, b bigint").select("a", "b", at._blocks_of_range(F.col("a"), F.col("b")).alias("blocks"))
    lines = [0, 1, 4, 5, 126, 127, 128, 255, 256, 299, 300, 16_000, 16_383, 16_384, 39_999, 40_000, 40_001, 900_000, 2_097_151, 2_097_152, 4_194_303, 9_999_999, 10_000_000]
    of_line = {r[0]: set(r[1]) for r in spark.createDataFrame([(x,) for x in lines], "x bigint").select("x", at._blocks_of_line(F.col("x"))).collect()}
    for r in df.collect():
        blocks = r["blocks"] or []
        assert len(blocks) <= 700 and len(set(blocks)) == len(blocks)
        for x in lines:
            met = len(of_line[x] & set(blocks))
            assert met <= 1 and (met == 1 or not r["a"] <= x <= r["b"])


def test_trailing_count(spark):
    rows = timeline()
    df = spark.createDataFrame(rows, "k string, t bigint, seq bigint, v bigint")
    got = {r["seq"]: r["n"] for r in od.trailing_count(df, ["k"], F.col("t"), 300, "n").collect()}
    assert got == {r[2]: sum(1 for o in rows if o[0] == r[0] and r[1] - 300 <= o[1] <= r[1]) for r in rows}


def test_trailing_count_sums_each_second_once(spark):
    """Every second of three blocks has rows: no frame slides, which would add up a whole span for each second."""
    rows = [("hot", t, 3 * t + i, 0) for t in range(900) for i in range(1 + t % 3)] + [("k", None, -1, 0), (None, 5, -2, 0)]
    df = spark.createDataFrame(rows, "k string, t bigint, seq bigint, v bigint")
    out = od.trailing_count(df, ["k"], F.col("t"), 300, "n")
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "-300" not in plan
    got = {r["seq"]: r["n"] for r in out.collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert got == {r[2]: sum(1 + t % 3 for t in range(max(0, r[1] - 300), r[1] + 1)) for r in rows[:-2]}


def test_attribution_and_changed_units(spark):
    units, findings, ranges = [], [], []
    for path in ("hot", "a", "b"):
        for i in range(60 if path == "hot" else 8):
            start = RNG.randrange(1, 900)
            units.append((path, i, start, start + RNG.randrange(0, 400), i * 10))
    for i in range(500):
        findings.append((skewed_key() if i % 5 else "hot", 1 if i % 3 == 0 else RNG.randrange(1, 1400), i))
    for i in range(40):
        first = RNG.randrange(1, 1400)
        ranges.append((RNG.choice(["hot", "a", "c"]), first, first + RNG.randrange(-1, 30)))
    u = spark.createDataFrame(units, "path string, ordinal int, start_line int, end_line int, score int")
    f = spark.createDataFrame(findings, "file string, line int, no int")
    r = spark.createDataFrame(ranges, "path string, first_line int, last_line int")
    got = {x["no"]: (x["unit_ordinal"], x["ai_score"]) for x in at.attribute(f, u, payload=("score",)).collect()}
    for path, line, no in findings:
        inside = [x for x in units if x[0] == path and x[2] <= line <= x[3]]
        first = min(inside, key=lambda x: x[1]) if inside else None
        assert got[no] == ((first[1], first[4]) if first else (None, 9))
    kept = {(x["path"], x["ordinal"]) for x in at.changed_units(u, r).collect()}
    assert kept == {(x[0], x[1]) for x in units if any(p == x[0] and a <= b and x[2] <= b and x[3] >= a for p, a, b in ranges)}


def test_sweep_equals_the_cross_product(spark):
    samples = [(RNG.choice(["ai", "human"]), RNG.randrange(0, 101)) for _ in range(300)]
    df = spark.createDataFrame(samples, "label string, score int")
    for row in cal.sweep(df).collect():
        t = row["threshold"]
        want = [sum(1 for label, s in samples if (s >= t) == hit and (label == "ai") == ai) for hit, ai in ((True, True), (True, False), (False, False), (False, True))]
        assert [row["tp"], row["fp"], row["tn"], row["fn"]] == want


def replay(attempts):
    state, locks = {}, []
    for user, us, seq, ok in sorted(attempts, key=lambda a: (a[0], a[1], a[2])):
        failed, until = state.get(user, (0, 0))
        if until > us:
            continue
        failed = 0 if ok else failed + 1
        if failed >= 5:
            failed, until = 0, us + ac.LOCK_MICROS
            locks.append((user, us))
        state[user] = (failed, until)
    return sorted(locks)


@pytest.mark.parametrize("good", [0.0, 0.1, 0.3])
def test_lockouts(spark, good):
    attempts = [
        (0 if RNG.random() < 0.6 else RNG.randrange(1, 5), RNG.randrange(0, 3 * 86_400) * 1_000_000, i, RNG.random() < good)
        for i in range(1500)
    ]
    df = spark.createDataFrame(attempts, "user_id bigint, us bigint, seq bigint, ok boolean").withColumn("ts", F.timestamp_micros("us"))
    got = sorted((r["user_id"], r["locked_at_us"]) for r in ac.lockouts(df).collect())
    assert got == replay(attempts) and len(got) > 5


def test_sessions_across_slices(spark):
    rows = [(k, t) for k, t, _, _ in timeline(300, 60_000)]
    df = spark.createDataFrame(rows, "target string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r["target"], r["start_us"] // 10**6, r["end_us"] // 10**6, r["scans"]) for r in ac.activity_sessions(df, 600, 1000).collect())
    want = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        start = before = times[0]
        n = 0
        for t in [*times, None]:
            if t is None or t - before >= 600:
                want.append((key, start, before + 600, n))
                start, n = t, 0
            n, before = n + 1, t
    assert got == sorted(want)


def test_no_attempts_no_locks(spark):
    df = spark.createDataFrame([], "user_id bigint, ts timestamp, seq bigint, ok boolean")
    assert ac.lockouts(df).count() == 0


def test_delta_with_repeated_ids(spark):
    side = lambda n: [("hot" if RNG.random() < 0.4 else f"i{RNG.randrange(40)}", RNG.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW"])) for _ in range(n)]
    now, old = side(200), side(150)
    make = lambda rows: spark.createDataFrame(rows, "id string, severity string")
    row = dl.delta_summary(make(now), make(old)).first()
    fresh = [x for x in now if x[0] not in {o[0] for o in old}]
    gone = [x for x in old if x[0] not in {o[0] for o in now}]
    assert (row["new_findings"], row["resolved_findings"]) == (len(fresh), len(gone))
    assert row["new_critical"] == sum(s == "CRITICAL" for _, s in fresh)
    assert (row["findings_current"], row["findings_previous"]) == (200, 150)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_has_a_cross_join(spark, sf_dir):
    streams_and_loops = {n for n in QUERIES if n.startswith(("stream_", "lockout_", "progress_"))}
    for name in sorted(set(QUERIES) - streams_and_loops):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan, name


def test_scoring_is_one_stage_without_a_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["score_documents"](spark, sf_dir))
    assert "Exchange hashpartitioning" not in plan and plan.count("FileScan") == 1


def test_filters_do_not_repeat_the_scoring(spark, sf_dir):
    for name in ("flagged_units", "invalid_api_findings", "secret_findings"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        filters = [line for line in plan.split("\n") if "Filter" in line]
        assert filters and all("regexp" not in line.lower() for line in filters), name


def test_scans_read_only_what_is_needed(spark, sf_dir):
    plan = plan_of(QUERIES["severity_share"](spark, sf_dir))
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan
    gate = plan_of(QUERIES["changed_files"](spark, sf_dir))
    assert "EqualTo(l_quantity,50.0)" in gate


@pytest.mark.parametrize("name", ["expression_units", "lexical_units", "import_bindings", "import_audit", "score_units"])
def test_work_on_narrow_rows_is_dealt_out(spark, sf_dir, name):
    """The table is one small file: without an exchange before the texts are made and searched, one task has them all."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    dealt = [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line]
    assert dealt and all("replace(" not in line for line in dealt)
    below = plan[plan.rindex("REPARTITION_BY_NUM"):]
    assert "regexp" not in below.lower() and "replace(" not in below.split("FileScan")[0]
