"""ST6: the failure lockout of an account as arbitrary state in a stream.

Attempts may arrive in any order within the watermark. They wait in the account's state until the
watermark has passed them, a timer wakes the account then, and they are replayed in the order of
their times. What is later than the watermark is dropped by Spark and counted in its progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkprint import fixed

OUTPUT = "user_id bigint, locked_at_us bigint"
STATE = "failed int, locked_until bigint, us array<bigint>, seq array<bigint>, ok array<boolean>"
LOCK_MICROS = fixed.LOCK_MINUTES * 60 * 1_000_000


def _replay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failed, locked_until, *waiting = state.get if state.exists else (0, 0, [], [], [])
    rows = list(zip(*waiting))
    for batch in batches:
        rows += zip(batch["us"].tolist(), batch["seq"].tolist(), batch["ok"].tolist())
    passed = state.getCurrentWatermarkMs() * 1000
    rows.sort()
    locks = []
    for us, _, ok in rows:
        if us >= passed:
            break
        if locked_until > us:
            continue
        failed = 0 if ok else failed + 1
        if failed >= fixed.MAX_FAILED_ATTEMPTS:
            failed, locked_until = 0, us + LOCK_MICROS
            locks.append(us)
    rest = [r for r in rows if r[0] >= passed]
    state.update((int(failed), int(locked_until), *([r[i] for r in rest] for i in range(3))))
    if rest:
        state.setTimeoutTimestamp(max(rest[0][0] // 1000, passed // 1000) + 1)
    yield pd.DataFrame({"user_id": [int(key[0]) for _ in locks], "locked_at_us": [int(x) for x in locks]})


def lock_events(attempts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Stream of ``user_id, ts, seq, ok`` to lock events; a lock is told once the watermark has passed it."""
    timed = attempts.withWatermark("ts", lateness).select("user_id", "ts", F.unix_micros("ts").alias("us"), "seq", "ok")
    return timed.groupBy("user_id").applyInPandasWithState(
        _replay, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
