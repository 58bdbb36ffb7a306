"""Row-multiplying and row-dropping steps that evaluate costly columns only once.

Catalyst copies an expression when it pushes a filter on a computed column below the
projection that computes it, and it puts a ``size(...) > 0`` filter below every explode. For
a scored unit, a parsed document or a regular-expression search that doubles the work. An
outer generator is exempt from both, and a filter on its output stays above it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    The variable of a lambda function cannot be copied to the places that name it, as a column can.
    """
    return F.get(F.transform(F.array(value), body), 0)


def explode_once(
    df: DataFrame, *keep: str | Column, items: Column, name: str = "item", position: str = "_pos"
) -> DataFrame:
    """One row per element of ``items``; rows without an element disappear."""
    out = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    out = out.filter(F.col(position).isNotNull())
    return out.drop(position) if position == "_pos" else out


def explode_entries(df: DataFrame, *keep: str | Column, entries: Column, key: str, value: str) -> DataFrame:
    """One row per entry of a map."""
    return df.select(*keep, F.explode_outer(entries).alias(key, value)).filter(F.col(key).isNotNull())


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose (costly) condition holds, without evaluating it a second time."""
    marked = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_keep"))
    return marked.filter(F.col("_keep").isNotNull()).drop("_keep")
