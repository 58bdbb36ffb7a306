"""Threshold calibration on a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.scalars import half_up

TARGET_PRECISION = 0.9
MIN_RECALL = 0.5


def sample_scores(scored: DataFrame, keys: tuple[str, ...] = ("path", "label")) -> DataFrame:
    """Rounded mean unit score per labelled file; files without a unit have no row."""
    return scored.groupBy(*keys).agg(
        half_up(F.sum("score") / F.count("*")).cast("int").alias("score"), F.count("*").alias("units")
    )


def corpus_counts(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("label") == "human").alias("human_files"),
        F.count_if(F.col("label") == "ai").alias("ai_files"),
    )


def _quality() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision = tp / F.greatest(F.lit(1.0), tp + fp)
    recall = tp / F.greatest(F.lit(1.0), tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall),
        "accuracy": (tp + tn) / F.greatest(F.lit(1.0), tp + fp + tn + fn),
    }


def sweep(samples: DataFrame) -> DataFrame:
    """Confusion counts and quality at every threshold from 0 to 100.

    Samples are counted per score first. The cumulative sums then run over 101 rows, however
    large the corpus; the result equals testing each sample against each threshold.
    """
    histogram = samples.groupBy("score").agg(
        F.count_if(F.col("label") == "ai").alias("ai"), F.count_if(F.col("label") != "ai").alias("human")
    )
    grid = samples.sparkSession.range(0, 101, 1, 1).select(F.col("id").cast("int").alias("threshold"))
    placed = grid.join(histogram, grid["threshold"] == histogram["score"], "left").select(
        "threshold", F.coalesce("ai", F.lit(0)).alias("ai"), F.coalesce("human", F.lit(0)).alias("human")
    )
    at_least = Window.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = placed.select(
        "threshold",
        F.sum("ai").over(at_least).alias("tp"),
        F.sum("human").over(at_least).alias("fp"),
        F.sum("ai").over(everything).alias("all_ai"),
        F.sum("human").over(everything).alias("all_human"),
    ).select(
        "threshold", "tp", "fp", (F.col("all_human") - F.col("fp")).alias("tn"), (F.col("all_ai") - F.col("tp")).alias("fn")
    )
    return counted.withColumns(_quality())


def best_threshold(
    evaluations: DataFrame, target_precision: float = TARGET_PRECISION, min_recall: float = MIN_RECALL
) -> DataFrame:
    """The best eligible threshold, or the best of all if none is eligible; ties: the lowest."""
    eligible = (F.col("precision") >= target_precision) & (F.col("recall") >= min_recall)
    return evaluations.orderBy(
        eligible.desc(), F.col("f1").desc(), F.col("precision").desc(), F.col("recall").desc(), "threshold"
    ).limit(1)


def detection_quality(samples: DataFrame, threshold: int) -> DataFrame:
    """Quality at one threshold, with the false-positive rate and 1 - precision."""
    above, is_ai = F.col("score") >= threshold, F.col("label") == "ai"
    counts = samples.agg(
        F.count_if(above & is_ai).alias("tp"), F.count_if(above & ~is_ai).alias("fp"),
        F.count_if(~above & ~is_ai).alias("tn"), F.count_if(~above & is_ai).alias("fn"),
    )
    return counts.withColumns({
        **_quality(), "false_positive_rate": F.col("fp") / F.greatest(F.lit(1), F.col("fp") + F.col("tn"))
    }).withColumn("false_discovery_rate", 1 - F.col("precision"))
