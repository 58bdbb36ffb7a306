"""What several operators of this subpackage share: stored steps, lookups of hot keys, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.session import work_folder

WORD = r"[^\x20\x09-\x0D]+"  # a run of characters that are no ASCII white space
HOT_PARTS = 1000  # a key is hot from a thousandth of all rows on, so there are at most so many hot keys
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, safe from lost executors."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get ``TEXT_ROWS`` rows at a time, or fewer if so set.

    Rows are whole texts here: Spark's ten thousand at a time are held by the executor and by its
    worker, and both keep the memory for later stages.
    """
    if int(spark.conf.get(_BATCH, "10000")) not in range(1, TEXT_ROWS + 1):
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Catalyst copies an expression to every place where a later step names its column; the variable
    of a lambda function cannot be copied.
    """
    return F.get(F.transform(F.array(value), body), 0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay, so every engine agrees."""
    return F.translate(text, _UPPER, _LOWER)


def split_of(doc_id: Column, folds: int) -> Column:
    """The remainder of crc32 of the id's text; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """``left`` joined with one row per key of ``right`` although few keys may hold most rows of ``left``.

    ``weight`` is the number of left rows with the key. Keys with a thousandth of ``total`` or more
    are at most a thousand, so they are broadcast; no other key can unbalance the shuffled join.
    Both sides should be stored. Null keys match nothing.
    """
    is_hot = F.col(weight) * HOT_PARTS >= F.lit(total)
    hot, cold = right.filter(is_hot), right.filter(~is_hot)
    near = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(rest)


def components(spark: SparkSession, edges: DataFrame, node_type: str, rounds: int = 100) -> DataFrame:
    """Connected components: (node, label) of every node of ``edges`` (a, b); label is the smallest node.

    Smallest labels travel over the links and along the labels (pointer doubling), so the number
    of rounds grows with the logarithm of the longest chain. Every round is stored. Sums of a
    node's links combine before the shuffle; the joins are of stored tables, which adaptive
    execution splits where one node has many links.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "links",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = stored(
            labels.join(heard, labels["node"] == heard["a"], "left")
            .select("node", "label", F.least("label", "heard").alias("nearer")), "labels",
        )
        parents = nearer.select(F.col("node").alias("parent"), F.col("nearer").alias("above"))
        jumped = stored(
            nearer.join(parents, nearer["nearer"] == parents["parent"], "left")
            .select("node", F.least("nearer", "above").alias("label"),
                    (F.least("nearer", "above") != F.col("label")).alias("moved")), "labels",
        )
        labels = jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"no end after {rounds} rounds")
