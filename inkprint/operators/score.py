"""Score assembly: total, flag, band, explanation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.config import DEFAULT_CONFIG, ScanConfig
from inkprint.functions.rows import keep_rows
from inkprint.functions.scalars import half_up, steady
from inkprint.operators.ordering import join_spread
from inkprint.operators.signals import SIGNALS, figures, signal_scores

N_SIGNALS = len(SIGNALS)
TOP_SIGNALS = 3


def _points() -> Column:
    return reduce(add, (F.col(s.column) for s in SIGNALS))


def band(score: Column) -> Column:
    low, high = fixed.BAND_CUTS
    return F.when(score < low, "LOW").when(score < high, "UNCERTAIN").otherwise("HIGH")


def total_score(points: Column, weights) -> Column:
    return half_up(points / F.lit(float(sum(weights[s.name] for s in SIGNALS))) * 100).cast("int")


def score_units(units: DataFrame, config: ScanConfig = DEFAULT_CONFIG) -> DataFrame:
    """Unit table plus figures, signal columns, ``points``, ``score``, ``flagged``, ``band``.

    Flat columns, so that Catalyst drops every signal and figure a later step does not read.
    """
    scored = signal_scores(figures(units), config.weights).withColumn("points", _points())
    scored = scored.withColumn("score", total_score(F.col("points"), config.weights))
    return scored.withColumns({"flagged": F.col("score") >= config.threshold, "band": band(F.col("score"))})


def signals_triggered() -> Column:
    return reduce(add, ((F.col(s.column) > 0).cast("int") for s in SIGNALS))


def score_variance() -> Column:
    """Rounded population variance of the signal scores, in exact integers until the end."""
    squares = reduce(add, (F.col(s.column) * F.col(s.column) for s in SIGNALS))
    return half_up((N_SIGNALS * squares - F.col("points") * F.col("points")) / (N_SIGNALS * N_SIGNALS)).cast("int")


def top_signals(limit: int = TOP_SIGNALS) -> Column:
    """Highest signals with their share of all points; ties keep the signal order."""
    ranked = F.sort_array(
        F.filter(
            F.array(*[
                F.struct((-F.col(s.column)).alias("rank"), F.lit(i).alias("place"), F.lit(s.name).alias("signal"))
                for i, s in enumerate(SIGNALS)
            ]),
            lambda x: x["rank"] < 0,
        )
    )
    return F.transform(
        F.slice(ranked, 1, limit),
        lambda x: F.struct(
            x["signal"].alias("signal"),
            half_up(-x["rank"] / F.col("points") * 100).cast("int").alias("contribution"),
            (-x["rank"]).cast("int").alias("score"),
        ),
    )


def explained() -> Column:
    return F.struct(
        F.col("score").alias("score"),
        F.col("band").alias("band"),
        signals_triggered().alias("signals_triggered"),
        score_variance().alias("variance"),
        top_signals().alias("top_signals"),
    )


def no_explanation(score: int = 0) -> Column:
    return F.struct(
        F.lit(score).alias("score"),
        F.lit("LOW").alias("band"),
        F.lit(0).alias("signals_triggered"),
        F.lit(0).alias("variance"),
        F.array().cast("array<struct<signal:string,contribution:int,score:int>>").alias("top_signals"),
    )


def signal_array(config: ScanConfig = DEFAULT_CONFIG) -> Column:
    """The thirteen signals as an array of structs, evidence included."""
    return F.array(*[
        F.struct(
            F.lit(s.name).alias("signal"),
            F.col(s.column).alias("score"),
            F.lit(config.weights[s.name]).alias("max_weight"),
            s.evidence().alias("evidence"),
        )
        for s in SIGNALS
    ])


def scored_unit_table(scored: DataFrame, config: ScanConfig = DEFAULT_CONFIG) -> DataFrame:
    """The nested form of a scored unit: identity, score, signals, explanation."""
    identity = [c for c in ("id", "path", "name", "kind", "start_line", "end_line", "ordinal", "code", "loc")
                if c in scored.columns]
    return scored.select(
        *identity, "score", "flagged", "band",
        signal_array(config).alias("signals"), explained().alias("explained"),
    )


def listed_units(scored: DataFrame, verbose: bool = False) -> DataFrame:
    """Flagged units, or all of them."""
    return scored if verbose else keep_rows(scored, F.col("flagged"))


# --- repository baseline (A19, A24, G22) ---------------------------------------------

CASE_SHAPES = {
    "camel": r"^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$",
    "snake": r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$",
    "pascal": r"^[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)?$",
}


def case_mix(names: Column) -> dict[str, Column]:
    """How many of the names are written in each case."""
    return {
        f"{case}_names": F.size(F.filter(names, lambda n: n.rlike(shape))).cast("bigint")  # noqa: B023
        for case, shape in CASE_SHAPES.items()
    }


def style_moments() -> list[Column]:
    return [
        F.avg("ident_entropy").alias("entropy_mean"),
        F.stddev_pop("ident_entropy").alias("entropy_stddev"),
        F.avg("comment_ratio").alias("comment_mean"),
        F.stddev_pop("comment_ratio").alias("comment_stddev"),
    ]


def repo_fingerprint(with_figures: DataFrame, repo: str) -> DataFrame:
    """One row per repository: means and deviations of its style."""
    staged = with_figures.select(
        repo, "ident_entropy", "comment_ratio", "loc", "complexity", *[
            column.alias(name) for name, column in case_mix(F.col("identifiers")).items()
        ],
    )
    return staged.groupBy(repo).agg(
        F.count("*").alias("units"),
        *style_moments(),
        *[F.sum(f"{case}_names").alias(f"{case}_names") for case in CASE_SHAPES],
        F.avg("complexity").alias("mean_complexity"),
        F.avg("loc").alias("mean_loc"),
    )


def baseline_deviation(with_figures: DataFrame, baseline: DataFrame, repo: str) -> DataFrame:
    """Distance of each unit from its repository's style, in standard deviations."""
    style = baseline.select(repo, "entropy_mean", "entropy_stddev", "comment_mean", "comment_stddev")
    joined = join_spread(with_figures, style, [repo], "inner")
    distance = lambda x, mean, sd: F.when(sd > 1e-9, F.abs(x - mean) / sd).otherwise(F.lit(0.0))
    return joined.withColumns({
        "entropy_deviation": steady(distance(F.col("ident_entropy"), F.col("entropy_mean"), F.col("entropy_stddev"))),
        "comment_deviation": steady(distance(F.col("comment_ratio"), F.col("comment_mean"), F.col("comment_stddev"))),
    })
