"""Order-dependent steps per key that stay balanced when one key holds a large part of all rows.

A window over the whole timeline of a key puts that key into one task. Here the timeline is cut
into slices: windows run per key and slice, and what has to pass from one slice to the next travels
through a summary with one row per key and slice. Slices hold about as many rows as each other
(`row_slices`), whatever the key or the time: all rows are sorted into ranges, so that a key with
most rows lies in many of them. Callers whose rows must not be sorted bring slices of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.session import work_folder

HOT_PARTS = 1000  # a key with a thousandth of all rows is hot, so there are at most a thousand of them
SALTS = 64


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` joined with at most one row per key of ``right``, also where few keys hold most of ``left``.

    Hot keys are counted (combined before the shuffle) and, being a thousand at most, broadcast to
    both sides. Their rows are dealt out over the salts by a hash of the row, so that a task that is
    run again deals them alike, and their right rows are repeated once per salt; all other keys have
    one salt.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all")).scalar()
    hot = F.broadcast(counts.filter(F.col("_n") * HOT_PARTS >= total).select(*keys, F.lit(True).alias("_hot")))
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.join(hot, list(keys), "left").withColumn("_salt", dealt).drop("_hot")
    copies = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def row_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``_slice``: the number of the range of rows, sorted by keys and order, that the row lies in.

    The rows are written once: ranges come from a sample, and a task that is run again must find
    each row in the slice where the others have counted it.
    """
    spark = df.sparkSession
    path = work_folder(spark, "slices")
    df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id().cast("bigint")).write.parquet(path)
    return spark.read.parquet(path)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_of: Column | None) -> DataFrame:
    return row_slices(df, keys, order) if slice_of is None else df.withColumn("_slice", slice_of)


def _largest(value: Column, order: Sequence[str]) -> Column:
    return F.max(value)


def _latest(value: Column, order: Sequence[str]) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


RUNNING = {
    # over a window, over a slice, and of what came before with what is here
    "max": (F.max, _largest, F.greatest),
    "last": (lambda v: F.last(v, ignorenulls=True), _latest, lambda before, here: F.coalesce(here, before)),
}


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, how: str, inclusive: bool = True
) -> DataFrame:
    """Adds ``name``: the largest or the last ``value`` that is not null among the rows of the key up to this one.

    ``how`` is "max" or "last"; ``order`` must tell all rows of a key apart. If not ``inclusive``
    the row itself does not count.
    """
    along, of_slice, joined_with = RUNNING[how]
    staged = row_slices(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        staged.groupBy(*keys, "_slice").agg(of_slice(F.col(value), order).alias("_end"))
        .withColumn("_carry", along(F.col("_end")).over(earlier)).drop("_end")
    )
    joined = staged.withColumn("_here", along(F.col(value)).over(inside)).join(carried, [*keys, "_slice"], "left")
    return joined.withColumn(name, joined_with(F.col("_carry"), F.col("_here"))).drop("_carry", "_here", "_slice")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slice_of: Column | None = None
) -> DataFrame:
    """Adds ``prev_<value>``: the value of the preceding row of the same key.

    ``slice_of`` must not decrease along ``order``; slices of equal rows if there is none.
    """
    packed = F.struct(*values)
    staged = _sliced(df, keys, order, slice_of)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ends = (
        staged.groupBy(*keys, "_slice")
        .agg(F.max_by(packed, F.struct(*order)).alias("_end"))
        .withColumn("_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice")))
        .drop("_end")
    )
    joined = staged.withColumn("_before", F.lag(packed).over(inside)).join(ends, [*keys, "_slice"], "left")
    before = F.coalesce("_before", "_carry")
    return joined.withColumns({f"prev_{v}": before[v] for v in values}).drop("_before", "_carry", "_slice")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_of: Column | None = None, name: str = "position"
) -> DataFrame:
    """Adds the 1-based position of each row along ``order`` within its key."""
    staged = _sliced(df, keys, order, slice_of)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
        .drop("_n")
    )
    return (
        staged.withColumn("_place", F.row_number().over(inside).cast("bigint"))
        .join(offsets, [*keys, "_slice"], "left")
        .withColumn(name, F.col("_place") + F.col("_offset"))
        .drop("_place", "_offset", "_slice")
    )


def with_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds ``first_<value>`` of each key: one pre-aggregated row per key, joined back."""
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    joined = join_spread(df, firsts, keys)
    return joined.withColumns({f"first_{v}": F.col("_first")[v] for v in values}).drop("_first")


def trailing_count(
    df: DataFrame, keys: Sequence[str], seconds: Column, span: int, name: str = "trailing"
) -> DataFrame:
    """Adds how many rows of the key fall into the last ``span`` seconds, the row included.

    Rows of one second count once, with their number. Each second goes to its own block of ``span``
    seconds, where it counts from then on, and as history to the next one, where it counts from the
    start until it is too old. So the count is a running sum over one block, three rows per second
    of the span at most, whatever the number of seconds in the span. The rows join their second.
    """
    own = F.floor(F.col("_sec") / span)
    each = df.withColumn("_sec", seconds)
    # what a second changes: in which block, when, whether after the rows of that second, and by how many
    change = lambda block, at, late, rows, here: F.struct(
        block.alias("_block"), at.alias("_at"), F.lit(late).alias("_late"), rows.alias("_change"), F.lit(here).alias("_here")
    )
    sec, rows = F.col("_sec"), F.col("_rows")
    changes = F.array(
        change(own, sec, False, rows, True),
        change(own + 1, sec, False, rows, False),
        change(own + 1, sec + span, True, -rows, False),
    )
    staged = each.groupBy(*keys, "_sec").agg(F.count("*").alias("_rows")).select(*keys, "_sec", F.explode(changes).alias("_c")).select(*keys, "_sec", "_c.*")
    so_far = Window.partitionBy(*keys, "_block").orderBy("_at", "_late").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    trailing = staged.withColumn(name, F.sum("_change").over(so_far)).filter("_here").select(*keys, "_sec", name)
    return each.join(trailing, [*keys, "_sec"], "left").drop("_sec")
