"""Quality rules whose cutoffs are chosen under a guarantee on false rejections.

Fixed base rules come first. Then, per stratum (language) and rule, labelled good documents serve
as a hold-out: a cutoff is certified when the exact binomial tail makes it implausible that it
rejects more than its share of good documents. Cutoffs are tested from the loosest to the
strictest and testing stops at the first failure (fixed sequence), which needs no correction;
over strata and rules the error is divided (Bonferroni).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import stored

SYMBOLS = "#*$%&|<>"
BASE_WORDS, BASE_REPEAT = 20, 30
WINDOW = 8
RISK = 0.02  # share of good documents all rules together may reject, per stratum
ERROR = 0.05  # probability that any of the guarantees does not hold
STEPS = 200  # cutoffs per rule
MAX_STRATA = 1000  # the table of cutoffs goes to every task, so its size is checked
_SPACE = " \t\n\v\f\r"

# rule: what it counts, and out of what; the share, at most 1, is its value, higher is worse
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
}


def step_of(rule: str) -> Column:
    count, whole = RULES[rule]
    return F.least(F.lit(STEPS), F.floor(STEPS * F.col(count) / F.greatest(F.lit(1), F.col(whole)))).cast("int")


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Word numbers are doubled into numbers of longer runs by sorting, so equality is exact and the
    cost is that of a few sorts, whatever the text repeats.
    """
    n = len(words)
    if n <= window:
        return 0
    first: dict = {}
    ids = np.array([first.setdefault(w, len(first)) for w in words], np.int64)
    if len(first) == n:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        top = int(ids.max()) + 1
        distinct, ids = np.unique(ids[: len(ids) - step] * top + ids[step:], return_inverse=True)
        if len(distinct) == len(ids):
            return 0
        length += step
    hit = np.bincount(ids)[ids] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def capitals(text: str) -> int:
    """Characters that lower case changes."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters become two
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(t.encode("utf-32-le", "replace"), "<u4") for t in (text, lower))
    return int(np.count_nonzero(a != b))


def figures_of(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # at ASCII white space
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words),
        lines, capitals(text), text.count("!") + text.count("?"),
    )


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """The figures of every whole text (null: no words), with its stratum. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [figures_of(value.as_py() or "") for value in batch.column(2)]
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)] or [pa.array([], pa.int64())] * len(FIGURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "stratum", *FIGURES])

    group = F.col(stratum).cast("string") if stratum else F.lit("all")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(group, F.lit("")).alias("stratum"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{x} long" for x in FIGURES))


def binomial_tail(rejected: int, n: int, risk: float) -> float:
    """P(at most ``rejected`` of ``n``) when each has the probability ``risk``; exact, summed in logarithms."""
    if rejected >= n:
        return 1.0
    i = np.arange(rejected + 1)
    steps = np.concatenate([[0.0], np.log((n - i[:-1]) / (i[:-1] + 1.0)) + math.log(risk) - math.log1p(-risk)])
    logs = n * math.log1p(-risk) + np.cumsum(steps)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def certify(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> int | None:
    """The step of the chosen cutoff, if any.

    ``good[s]`` and ``bad[s]`` count labelled documents at step s; a cutoff s rejects all at s and
    above. Certified cutoffs run from the loosest until the first that fails; among them the one
    that rejects most of the bad beyond its share of the good wins, the loosest one on ties.
    """
    over_good, over_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    n_good, n_bad = int(over_good[0]), int(over_bad[0])
    best, gain = None, 0.0
    for step in range(len(good) - 1, 0, -1):
        if not n_good or binomial_tail(int(over_good[step]), n_good, risk) > error:
            break
        now = over_bad[step] / max(1, n_bad) - over_good[step] / n_good
        if now > gain + 1e-12:
            best, gain = step, now
    return best


def choose_cutoffs(figures: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR,
                   label_id: str = "doc_id", quality: str = "quality") -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}} from all labelled documents; documents at or above a cutoff are rejected.

    Counts per stratum, rule and step combine before the shuffle and are all that reaches the driver.
    """
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("good")).filter("good IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("good").alias("good"))
    passed = figures.filter(~base_failed())
    steps = F.array(*(F.struct(F.lit(r).alias("rule"), step_of(r).alias("step")) for r in RULES))
    counts = (
        passed.join(marks, "doc_id").select("stratum", "good", F.explode(steps).alias("at"))
        .groupBy("stratum", "at.rule", "at.step").agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    )
    rows = counts.limit(MAX_STRATA * len(RULES) * (STEPS + 1) + 1).collect()
    strata = {r["stratum"] for r in rows}
    if len(strata) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    tables = {(s, r): np.zeros((2, STEPS + 1), np.int64) for s in strata for r in RULES}
    for row in rows:
        tables[row["stratum"], row["rule"]][:, row["step"]] += (row["good"], row["n"] - row["good"])
    share, each = risk / len(RULES), error / max(1, len(tables))
    chosen: dict[str, dict[str, float]] = {}
    for (s, r), (good, bad) in sorted(tables.items()):
        if (step := certify(good, bad, share, each)) is not None:
            chosen.setdefault(s, {})[r] = step / STEPS
    return chosen


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang",
          risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per document: its figures, base_failed and kept.

    Null and empty texts have no words and fail the base rules. A null stratum is a stratum of its
    own; a stratum with too few labelled documents to certify a cutoff has the base rules only.
    Repeated rows and null ids give a row each; a label that occurs twice counts as the worse one.
    """
    figures = stored(measure(docs, doc_id, text, stratum), "figures")
    cutoffs = choose_cutoffs(figures, labels, risk, error)
    entries = [(f"{s}\x1f{r}", c) for s, rules in cutoffs.items() for r, c in rules.items()]
    rejected = F.lit(False)
    if entries:
        table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(c)) for k, c in entries))
        for rule in RULES:
            cutoff = F.try_element_at(table, F.concat_ws("\x1f", "stratum", F.lit(rule)))
            rejected = rejected | F.coalesce(step_of(rule) >= F.round(cutoff * STEPS), F.lit(False))
    failed = base_failed()
    return figures.select(
        "doc_id", *FIGURES[:5], failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), "stratum", *FIGURES[5:]
    )
