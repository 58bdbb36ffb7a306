"""The thirteen stylometric signals.

Two layers. `figures` turns a unit into plain numbers in one projection. `SIGNALS` maps those
numbers to a score and an evidence text. Everything is a row-wise Column expression without
Python workers, so it runs alike in batch and in a stream and never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.functions import text as tx
from inkprint.functions.scalars import clamp, clamp01, half_up, steady
from inkprint.operators import units as un

_OBVIOUS = rf"(?i)//[{fixed.WS}]*(?:{'|'.join(fixed.OBVIOUS_COMMENT_VERBS)}){fixed.WORD_END}"
_GENERIC = rf"(?<![^\n])(?:{'|'.join(fixed.GENERIC_NAMES)})(?![^\n])"  # whole lines
_WORDS = "[A-Za-z0-9_]"
# what a text in lower case holds at least, then patterns in order
_BOILERPLATE = (
    ("async", rf"(?i)async[{fixed.WS}]+function[{fixed.WS}]+(?:get|create|update|delete){_WORDS}+"),
    ("try", rf"(?i)try[{fixed.WS}]*\{{", rf"(?i)\}}[{fixed.WS}]*catch[{fixed.WS}]*\(error\)"),
    ("res.status", r"(?i)res\.status\([0-9]{3}\)\.json"),
    ("usestate", r"(?i)useState\([^)]*\)", r"(?i)useEffect"),
)
_HELPER_CALLS = tuple(rf"(?i){verb}{_WORDS}*\([^)]*\)" for verb in ("validate", "format", "process"))


def _behind(text: Column, needles: tuple[str, ...], found: Column, nothing: Column) -> Column:
    """``found`` where the text holds a needle; a plain search is cheaper than a pattern that cannot match. Null stays null."""
    held = reduce(or_, (F.contains(text, F.lit(n)) for n in needles))
    return F.when(~held, nothing).otherwise(found)


def _pattern_figures(low: Column) -> dict[str, Column]:
    """``low`` is the code in lower case, in a column of its own."""
    code, no, none = F.col("code"), F.lit(False), F.lit(0)
    boilerplate = F.lit(0)
    for needle, *patterns in _BOILERPLATE:
        boilerplate = boilerplate + _behind(low, (needle,), tx.in_order(code, *patterns), no).cast("int")
    return {
        "obvious_comment": _behind(code, ("//",), code.rlike(_OBVIOUS), no),
        "empty_catch": _behind(code, ("catch",), code.rlike(f"(?s){fixed.EMPTY_CATCH}"), no),
        "null_checks": _behind(code, ("??", "?.", "=="), tx.hits(code, fixed.NULL_CHECKS), none),
        "boilerplate_hits": boilerplate,
        "helper_definitions": _behind(low, ("function",), tx.hits(code, fixed.HELPER_DEFINITIONS), none),
        "helper_sequence": _behind(low, ("validate",), tx.in_order(code, *_HELPER_CALLS), no),
        "emoji": F.when(F.octet_length(code) == F.length(code), no).otherwise(code.rlike(fixed.EMOJI)),
    }


def token_figures(stats: Column) -> dict[str, Column]:
    """From the run statistics of the tokens: count, entropy, repetition."""
    return {
        "token_count": stats["n"],
        "token_entropy": stats["entropy"],
        "token_repetition": steady(
            clamp01(1 - stats["distinct"] / F.greatest(F.lit(1).cast("bigint"), stats["n"]))
        ),
    }


def sentence_figures(sentences: Column, worded: Column) -> dict[str, Column]:
    """From the sentences, and those of them that hold a word: shape and openers."""
    n = F.size(worded).cast("bigint")
    add = lambda f: F.aggregate(worded, F.lit(0).cast("bigint"), lambda a, s: a + f(s))
    total, squares = add(lambda s: s["words"]), add(lambda s: s["words"] * s["words"])
    spread = F.sqrt((n * squares - total * total).cast("double")) / n
    mean = total / n
    enough = n > 0
    return {
        "sentence_count": F.size(sentences),
        "worded_count": F.size(worded),
        "sentence_cv": F.when(enough, steady(spread / F.greatest(F.lit(1.0), mean))).otherwise(0.0),
        "opener_variety": F.when(
            enough, steady(F.size(F.array_distinct(F.transform(worded, lambda s: s["opener"]))) / n)
        ).otherwise(0.0),
    }


def _worded() -> Column:
    return F.filter("_sentences", lambda s: s["words"] > 0)


def perplexity_figures(units: DataFrame) -> DataFrame:
    staged = units.withColumn("_stats", tx.run_statistics(tx.tokens(F.col("code"))))
    return staged.withColumns(token_figures(F.col("_stats"))).drop("_stats")


def burstiness_figures(units: DataFrame) -> DataFrame:
    staged = units.withColumn("_sentences", tx.sentence_statistics(tx.sentence_tokens(F.col("code")))).withColumn("_words", _worded())
    return staged.withColumns(sentence_figures(F.col("_sentences"), F.col("_words"))).drop("_sentences", "_words")


def figures(units: DataFrame) -> DataFrame:
    """Unit table plus every number the signals are computed from.

    Columns ``identifiers``, ``loc`` and ``comment_lines`` are used where the table brings
    them (from a real parser) and derived from the code where it does not. Each stage reads
    columns of the stage before, so that no search or array is made twice.
    """
    code = F.col("code")
    given = {"identifiers": tx.identifiers(code), "comment_lines": tx.comment_lines(code)}
    read_from_code = {
        **{name: column for name, column in given.items() if name not in units.columns},
        "_indents": tx.indents(code),
        "_tokens": tx.sentence_tokens(code),
        **_pattern_figures(F.col("_low")),
    }
    shaped = {
        "_stats": tx.run_statistics(tx.all_tokens(F.col("_tokens"))),
        "_sentences": tx.sentence_statistics(F.col("_tokens")),
        # every line that is not blank has its indentation, and starts like a comment or not
        **({} if "loc" in units.columns else {"loc": F.size("_indents") - F.col("comment_lines") if "comment_lines" not in units.columns else tx.code_lines(code)}),
    }
    counted = {
        "_names": F.array_join("identifiers", "\n"),
        "_words": _worded(),
        "ident_count": F.size("identifiers"),
        "comment_ratio": un.comment_ratio(F.col("comment_lines"), F.col("loc")),
        "indent_lines": F.size("_indents"),
        "indent_levels": F.size(F.array_distinct("_indents")),
        "has_doc": un.has_doc_comment(F.col("prefix")),
        **token_figures(F.col("_stats")),
    }
    prepared = {
        "_joined": F.replace(F.col("_names"), F.lit("\n"), F.lit("")),
        "ident_generic": tx.hits(F.lower("_names"), _GENERIC),
        **sentence_figures(F.col("_sentences"), F.col("_words")),
    }
    entropy = {"ident_entropy": tx.character_entropy(F.col("_joined"))}
    staged = units
    for stage in ({"_low": F.lower(code)}, read_from_code, shaped, counted, prepared, entropy):
        staged = staged.withColumns(stage)
    return staged.drop("_low", "_indents", "_tokens", "_stats", "_sentences", "_names", "_joined", "_words")


@dataclass(frozen=True)
class Signal:
    name: str
    raw: Callable[[int], Column]
    evidence: Callable[[], Column]

    @property
    def column(self) -> str:
        return f"s_{self.name}"

    def score(self, weight: int) -> Column:
        return clamp(half_up(self.raw(weight)), F.lit(0).cast("bigint"), F.lit(weight).cast("bigint")).cast("int")


def _on(flag: str) -> Callable[[int], Column]:
    return lambda weight: F.when(F.col(flag), F.lit(float(weight))).otherwise(F.lit(0.0))


def _said(flag: str, yes: str, no: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(flag), yes).otherwise(no)


def _generic(weight: int) -> Column:
    return F.col("ident_generic") / F.greatest(F.lit(1), F.col("ident_count")) * weight * 3


def _comments(weight: int) -> Column:
    ratio = F.col("comment_ratio")
    return F.when(ratio >= 0.4, F.lit(float(weight))).otherwise(ratio / 0.4 * weight)


def _nulls(weight: int) -> Column:
    return F.least(F.lit(float(weight)), F.col("null_checks") * 2.0)


def _formatting(weight: int) -> Column:
    uniform = (F.col("indent_levels") <= 3) & (F.col("indent_lines") > 8)
    return F.when(uniform, F.lit(float(weight))).otherwise(F.lit(weight * 0.2))


def _naming(weight: int) -> Column:
    h = F.col("ident_entropy")
    return F.when(h < 3.2, F.lit(float(weight))).when(h < 3.8, F.lit(weight * 0.5)).otherwise(F.lit(0.0))


def _boilerplate(weight: int) -> Column:
    return F.col("boilerplate_hits") * F.lit(weight / 2)


def _helpers(weight: int) -> Column:
    ordered = (F.col("helper_definitions") >= 2) | F.col("helper_sequence")
    return F.when(ordered, F.lit(float(weight))).otherwise(F.lit(0.0))


def _perplexity(weight: int) -> Column:
    spread = clamp01((F.col("token_entropy") - 2.2) / 2.2)
    guess = clamp01((1 - spread) * 0.75 + F.col("token_repetition") * 0.25)
    return F.when(F.col("token_count") < 8, F.lit(0.0)).otherwise(steady(guess * weight))


def _burstiness(weight: int) -> Column:
    flat = clamp01((0.55 - F.col("sentence_cv")) / 0.55)
    alike = clamp01((0.75 - F.col("opener_variety")) / 0.75)
    thin = (F.col("sentence_count") < 3) | (F.col("worded_count") < 3)
    return F.when(thin, F.lit(0.0)).otherwise(steady((flat * 0.7 + alike * 0.3) * weight))


def _percent(name: str) -> Column:
    return half_up(F.col(name) * 100).cast("string")


SIGNALS: tuple[Signal, ...] = (
    Signal("genericNames", _generic,
           lambda: F.format_string("%d/%d identifiers are generic", "ident_generic", "ident_count")),
    Signal("commentRatio", _comments, lambda: F.format_string("comment ratio %.2f", "comment_ratio")),
    Signal("obviousComments", _on("obvious_comment"),
           _said("obvious_comment", "obvious explanatory comment found", "no obvious comments")),
    Signal("emptyCatch", _on("empty_catch"),
           _said("empty_catch", "empty or log-only catch block", "catch blocks include handling")),
    Signal("nullChecks", _nulls, lambda: F.format_string("%d defensive null/undefined checks", "null_checks")),
    Signal("formattingUniformity", _formatting, lambda: F.format_string("%d indentation levels", "indent_levels")),
    Signal("universalJsdoc", _on("has_doc"), _said("has_doc", "JSDoc present", "no JSDoc")),
    Signal("namingEntropy", _naming, lambda: F.format_string("identifier entropy %.2f", "ident_entropy")),
    Signal("boilerplatePatterns", _boilerplate,
           lambda: F.format_string("%d boilerplate patterns", "boilerplate_hits")),
    Signal("helperOrdering", _helpers,
           lambda: F.format_string("%d helper-like definitions", "helper_definitions")),
    Signal("emojiComments", _on("emoji"), _said("emoji", "emoji-like character found", "no emoji comments")),
    Signal("perplexity", _perplexity,
           lambda: F.when(F.col("token_count") < 8, "insufficient tokens for perplexity estimate").otherwise(
               F.concat(F.format_string("token entropy %.2f, repetition ", "token_entropy"),
                        _percent("token_repetition"), F.lit("%")))),
    Signal("burstiness", _burstiness,
           lambda: F.when(F.col("sentence_count") < 3, "insufficient sentence count for burstiness estimate")
           .when(F.col("worded_count") < 3, "insufficient tokenized sentences for burstiness estimate")
           .otherwise(F.concat(F.format_string("sentence cv %.2f, opener variety ", "sentence_cv"),
                               _percent("opener_variety"), F.lit("%")))),
)
SIGNAL_COLUMNS = tuple(s.column for s in SIGNALS)
BY_NAME: Mapping[str, Signal] = {s.name: s for s in SIGNALS}


def signal_scores(with_figures: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """Adds one integer column per signal, each between 0 and its weight."""
    return with_figures.withColumns({s.column: s.score(weights[s.name]) for s in SIGNALS})
