"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a fixed and of a learned lexicon (words and word beginnings), nearness of
the second person to them, capitals, punctuation and obfuscation. Two thirds of the ids may be
learned from: one of them for the lexicon and the trees, the other for the calibration.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import split_of, stored

TRAIN_ROWS = 20_000  # about so many labelled documents per part at most, taken by a hash of the id
LEXICON = 400  # learned entries at most
MIN_DOCS = 3  # labelled toxic documents an entry occurs in
STEM = 4  # characters of a word's beginning
THRESHOLD = 0.7
TREES, DEPTH, SEED = 20, 3, 7
NEAR = 5  # words

INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb loser losers scum trash garbage worthless pathetic"
    " disgusting clown fool fools jerk imbecile cretin vermin filth hate shut ugly crap damn hell bastard"
    " idiota estupido imbecil basura asqueroso idiote debile ordure connard dumm trottel abschaum ekelhaft".split()
)
SECOND = frozenset("you your yours yourself youre u ur tu te ti usted vous toi votre du dich dir ihr euch dein".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_MASKED = re.compile(r"[A-Za-z]+[@$*#0-9!]+[A-Za-z]+")
_SPELLED = re.compile(r"\b(?:[A-Za-z][.\-_* ]){3,}[A-Za-z]\b")
_DRAWN = re.compile(r"([A-Za-z])\1{2,}")
_PLAIN = str.maketrans("@$01345!*#7.-_ ", "asoieasi__t____")  # what a sign inside a word may stand for
_MARKS = re.compile(r"[!?]{2,}")

FEATURES = (
    "fixed_density", "fixed_kinds", "learned_density", "learned_max", "learned_kinds", "near_second", "second_density",
    "capital_share", "capital_words", "exclamations", "questions", "mark_runs", "masked", "spelled", "drawn", "log_words",
)


def features_of(text: str, learned: dict[str, float]) -> list[float]:
    words = _TOKEN.findall(text)
    masked, spelled = _MASKED.findall(text), [m.group() for m in _SPELLED.finditer(text)]
    lower = [w.lower() for w in words] + [w.lower().translate(_PLAIN).replace("_", "") for w in masked + spelled]
    n = max(1, len(words))
    fixed = [i for i, w in enumerate(lower) if w in INSULTS]
    hits = [(i, s) for i, w in enumerate(lower) if (s := learned.get(w) or learned.get(w[:STEM] + "-"))]
    second = [i for i, w in enumerate(lower) if w in SECOND]
    bad = np.array(sorted({*fixed, *(i for i, _ in hits)}))
    near = 0
    if len(bad) and second:
        at = np.array(second)
        place = np.searchsorted(at, bad)
        gap = np.minimum(np.abs(bad - at[np.minimum(place, len(at) - 1)]), np.abs(bad - at[np.maximum(place - 1, 0)]))
        near = int((gap <= NEAR).sum())
    folded = text.lower()
    upper = (len(text) - sum(a == b for a, b in zip(text, folded))) if not text.isascii() else len(_UPPER.findall(text))
    chars = max(1, len(text))
    return [
        len(fixed) / n, len({lower[i] for i in fixed}), len(hits) / n, max((s for _, s in hits), default=0.0), len({lower[i] for i, _ in hits}),
        near / n, len(second) / n, upper / chars, sum(w.isupper() and len(w) > 1 for w in words) / n, text.count("!") / chars, text.count("?") / chars,
        len(_MARKS.findall(text)) / n, len(masked) / n, len(spelled) / n, len(_DRAWN.findall(text)) / n, math.log1p(len(words)),
    ]


_UPPER = re.compile("[A-Z]")


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    n = labelled.count()
    part = int(min(1.0, rows / max(1, n)) * (1 << 30))
    return labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part)


def learn_lexicon(docs: DataFrame, marks: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Words and word beginnings that labelled toxic documents have far more often, with their log odds.

    ``marks`` (doc_id, toxic) is bounded. Documents per entry are counted before the shuffle, the
    entries are ranked, and ``size`` of them reach the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    stems = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(w.substr(1, STEM), F.lit("-"))))
    texts = docs.join(F.broadcast(marks), "doc_id").select("toxic", words.alias("words"), stems.alias("stems"))
    totals = texts.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = totals["bad"] or 0, totals["n"] - (totals["bad"] or 0)
    counts = (
        texts.select("toxic", F.explode(F.concat("words", "stems")).alias("entry"))
        .groupBy("entry").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
        .filter(F.col("bad") >= MIN_DOCS)
    )
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1.0))
    top = counts.withColumn("odds", odds).filter("odds > 2").orderBy(F.desc(F.col("odds") * F.log1p("bad")), "entry").limit(size)
    return {r["entry"]: float(r["odds"]) for r in top.collect()}


def describe(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """doc_id and the features of every whole text; null counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features_of(value.as_py() or "", learned) for value in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *FEATURES])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          toxic: str = "toxic", folds: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Labels are read only of ids whose remainder is not ``held_out``. Null and empty texts are scored
    like texts without words. Where either class has no labelled document every score is the share
    of toxic labels (0.0 without labels). Repeated rows and null ids give a row each; of repeated
    labels the worse one counts.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fold = split_of(F.col("doc_id"), folds)
    marks = (
        labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    marks = stored(marks.withColumn("fold", fold), "marks")
    to_fit, to_set = (held_out + 1) % folds, (held_out + 2) % folds
    fit = stored(_sample(marks.filter(F.col("fold") == to_fit), rows), "fit")
    calibrate = stored(_sample(marks.filter(F.col("fold") == to_set), rows), "set")
    learned = learn_lexicon(narrow, fit.select("doc_id", "toxic"))
    features = stored(describe(narrow, learned), "features")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    known = stored(features.join(F.broadcast(fit.union(calibrate)), "doc_id"), "known")
    seen = {(r["fold"], r["toxic"]): r["count"] for r in known.groupBy("fold", "toxic").count().collect()}
    held = (fold == held_out).alias("held_out")
    if not seen.get((to_fit, 0)) or not seen.get((to_fit, 1)):
        share = sum(n for (_, t), n in seen.items() if t == 1) / max(1, sum(seen.values()))
        return _result(features.select("doc_id", held, F.lit(float(share)).alias("score")))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, minInstancesPerNode=5, seed=SEED,
        subsamplingRate=1.0, cacheNodeIds=False,
    ).fit(assembled.transform(known.filter(F.col("fold") == to_fit)))
    keep = ["doc_id"]
    scored = trees.transform(assembled.transform(features)).select(*keep, vector_to_array("probability")[1].alias("raw"))
    if seen.get((to_set, 0)) and seen.get((to_set, 1)):
        ranked = trees.transform(assembled.transform(known.filter(F.col("fold") == to_set)))
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(
            ranked.select(vector_to_array("probability")[1].alias("raw"), F.col("toxic").cast("double").alias("toxic"))
        )
        at, level = np.array(isotonic.boundaries.toArray()), np.array(isotonic.predictions.toArray())
        return _result(scored.select("doc_id", held, _interpolate(F.col("raw"), at, level).alias("score")))
    return _result(scored.select("doc_id", held, F.col("raw").alias("score")))


def _interpolate(x: Column, at: np.ndarray, level: np.ndarray) -> Column:
    """The isotonic function as an expression; its steps are as many as the calibration made."""
    value = F.lit(float(level[0]))
    for i in range(1, len(at)):
        if at[i] > at[i - 1]:
            slope = (level[i] - level[i - 1]) / (at[i] - at[i - 1])
            value = F.when(x >= float(at[i - 1]), F.lit(float(level[i - 1])) + (x - float(at[i - 1])) * float(slope)).otherwise(value)
    return F.when(x >= float(at[-1]), F.lit(float(level[-1]))).otherwise(value)


def _result(scored: DataFrame) -> DataFrame:
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return scored.select("doc_id", "held_out", bounded.alias("score"), (bounded >= THRESHOLD).cast("int").alias("predicted"))
