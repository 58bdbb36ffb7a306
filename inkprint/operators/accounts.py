"""Account tables: sessions valid at a time, lockout replay, activity sessions (J8, ST6, ST7)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.operators.ordering import with_position
from inkprint.session import cut_lineage

LOCK_MICROS = fixed.LOCK_MINUTES * 60 * 1_000_000


def valid_sessions(sessions: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """Sessions of known users that are not revoked and expire after ``at``."""
    live = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > at))
    return live.join(users, "user_id")


def activity_sessions(history: DataFrame, gap_seconds: int, slice_seconds: int = 86_400) -> DataFrame:
    """Runs of activity of a target with no pause of ``gap_seconds`` or more.

    Events less than a gap apart are one run, so those of one interval of that length are counted
    first, before the shuffle: a target has a row per interval at most, however busy it is. Runs
    are then found within slices of time, and the runs of neighbouring slices are joined.
    """
    gap = gap_seconds * 1_000_000
    us = F.unix_micros("ts")
    staged = (
        history.groupBy("target", F.floor(us / gap).alias("interval"))
        .agg(F.min(us).alias("from"), F.max(us).alias("to"), F.count("*").alias("rows"))
        .withColumn("slice", F.floor(F.col("from") / (slice_seconds * 1_000_000)))
    )
    inside = Window.partitionBy("target", "slice").orderBy("from")
    apart = lambda now, before: (before.isNull() | (now - before >= gap)).cast("int")
    runs = (
        staged.withColumn("opens", apart(F.col("from"), F.lag("to").over(inside)))
        .withColumn("run", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("target", "slice", "run")
        .agg(F.min("from").alias("first"), F.max("to").alias("last"), F.sum("rows").alias("scans"))
    )
    along = Window.partitionBy("target").orderBy("first")
    return (
        runs.withColumn("opens", apart(F.col("first"), F.lag("last").over(along)))
        .withColumn("session", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("target", "session")
        .agg(F.min("first").alias("start_us"), (F.max("last") + gap).alias("end_us"), F.sum("scans").alias("scans"))
        .drop("session")
    )


# --- lockout replay ----------------------------------------------------------------------


def lock_candidates(attempts: DataFrame) -> DataFrame:
    """Every point where five attempts in a row have failed, locks not yet regarded.

    ``user_id, place`` (of the fifth), ``first_us`` and ``last_us`` (times of the first and the
    fifth). Each failure is counted at the five places it can be part of, so the shuffle key
    is user and place and an account under attack is spread like any other.
    """
    staged = attempts.select("user_id", "ok", "seq", F.unix_micros("ts").alias("us"))
    numbered = with_position(staged, ["user_id"], ["us", "seq"])
    reach = F.sequence(F.col("position"), F.col("position") + fixed.MAX_FAILED_ATTEMPTS - 1)
    return (
        numbered.filter(~F.col("ok"))
        .select("user_id", "us", F.explode(reach).alias("place"))
        .groupBy("user_id", "place")
        .agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        .filter(F.col("n") == fixed.MAX_FAILED_ATTEMPTS)
        .drop("n")
    )


def _with_next(candidates: DataFrame) -> DataFrame:
    """Adds the place of the lock that follows if the row locks.

    That is the first candidate whose five attempts all lie after the lock has expired: a
    look ahead in time, done per user and day with the later days summed up per day.
    """
    day = F.floor(F.col("at") / 86_400_000_000)
    points = candidates.select(
        "user_id", F.col("first_us").alias("at"), F.lit(1).alias("kind"), F.col("place").alias("found"), "place"
    ).unionByName(candidates.select(
        "user_id", (F.col("last_us") + LOCK_MICROS).alias("at"), F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("found"), "place",
    )).withColumn("day", day)
    onwards = Window.partitionBy("user_id", "day").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    later_days = Window.partitionBy("user_id").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_day = (
        points.groupBy("user_id", "day").agg(F.min("found").alias("earliest"))
        .withColumn("later", F.min("earliest").over(later_days)).drop("earliest")
    )
    return (
        points.withColumn("same_day", F.min("found").over(onwards))
        .join(per_day, ["user_id", "day"])
        .filter("kind = 0")
        .select("user_id", "place", F.coalesce("same_day", "later").alias("next"))
    )


def lockouts(attempts: DataFrame) -> DataFrame:
    """ST6 as a batch: when each account got locked (``user_id, locked_at_us, seq_no``).

    ``attempts``: ``user_id, ts, ok, seq``. The locks of an account form a chain from its first
    candidate. The chain is followed by doubling: each round joins the jumps with themselves,
    so the rounds grow with the logarithm of the longest chain.
    """
    candidates = cut_lineage(lock_candidates(attempts))
    counted = candidates.groupBy("user_id").agg(
        F.count("*").alias("n"), (F.max("last_us") - F.min("first_us")).alias("span")
    )
    longest = counted.agg(F.max(F.least("n", F.floor(F.col("span") / LOCK_MICROS) + 1))).first()[0] or 0
    jumps = cut_lineage(_with_next(candidates).filter(F.col("next").isNotNull()))
    reached = candidates.groupBy("user_id").agg(F.min("place").alias("place"))
    for _ in range(math.ceil(math.log2(longest + 1))):
        onward = reached.join(jumps, ["user_id", "place"]).select("user_id", F.col("next").alias("place"))
        reached = cut_lineage(reached.unionByName(onward))
        ahead = jumps.select("user_id", F.col("place").alias("next"), F.col("next").alias("after"))
        jumps = cut_lineage(jumps.join(ahead, ["user_id", "next"]).select("user_id", "place", F.col("after").alias("next")))
    return candidates.join(reached, ["user_id", "place"], "left_semi").select(
        "user_id", F.col("last_us").alias("locked_at_us")
    )
