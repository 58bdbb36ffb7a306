"""Text Columns that stay inside the row: tokens, sentences, lines, entropy.

Entropy needs the frequency of every distinct token of a text. Counting with an explode and
a group-by would send every token of every text through a shuffle. Here each row sorts its
own token array and folds over the runs of equal neighbours: no shuffle, memory bounded by
one text, and the same expression works in a stream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.functions.rows import bind
from inkprint.functions.scalars import steady

WORD = "[a-z0-9_]+"
NAME_LIKE = r"[A-Za-z0-9_$]+"
# what such names are made of; order and groups are only for speed
NAME_CHARACTERS = ("etaoinsrhldcum", "fpgwybvkxjqz", "ETAOINSRHLDCUM", "FPGWYBVKXJQZ", "0123456789_$")
# Comments and literals. Possessive groups keep the matcher from recursing on long ones.
COMMENT_OR_LITERAL = (
    r"(?=[/\"'`])(?://[^\n]*|(?s:/\*.*?(?:\*/|\z))"
    r"|\"(?:[^\"\\\n]++|\\.)*+\"?"
    r"|'(?:[^'\\\n]++|\\.)*+'?"
    r"|`(?:[^`\\]++|(?s:\\.))*+`?)"
)
# The same, or a stretch of anything else: covers a source text without a gap.
MASK_PARTS = COMMENT_OR_LITERAL + r"|[^/\"'`]++|/"


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hits(text: Column, pattern: str) -> Column:
    return F.size(every(text, pattern))


def tokens(text: Column) -> Column:
    return every(F.lower(text), WORD)


def characters(text: Column) -> Column:
    """Code points of a text as an array."""
    return F.split(text, "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as the scanned language counts it."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def run_lengths(ordered: Column) -> Column:
    """Lengths of the runs of equal neighbours in a sorted array; the array is searched once for the places where a run begins."""

    def lengths(ordered: Column) -> Column:
        places = F.transform(ordered, lambda _, i: i)
        begins = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return bind(begins, lambda at: F.transform(at, lambda b, k: (F.coalesce(F.get(at, k + 1), F.size(ordered)) - b).cast("double")))

    return bind(ordered, lengths)


def _weighed(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0.0), lambda acc, run: F.when(run > 1, acc + run * F.log2(run)).otherwise(acc))


def run_statistics(items: Column, total: Column | None = None) -> Column:
    """Struct of ``n``, ``distinct`` and Shannon ``entropy`` (bits) of an array of texts.

    ``total`` replaces the array size as the denominator of the probabilities. All arithmetic is
    per distinct item.
    """
    count = lambda x: x.cast("bigint")

    def finish(ordered: Column, runs: Column) -> Column:
        n = F.size(ordered)
        size = (n if total is None else total).cast("double")
        # sum of -(c/L) log2(c/L) over the distinct items, L being the denominator
        entropy = F.when(size > 0, (n * F.log2(size) - _weighed(runs)) / size).otherwise(F.lit(0.0))
        return F.struct(count(n).alias("n"), count(F.size(runs)).alias("distinct"), steady(entropy).alias("entropy"))

    return bind(F.sort_array(items), lambda ordered: bind(run_lengths(ordered), lambda runs: finish(ordered, runs)))


def short_text_entropy(text: Column) -> Column:
    """Shannon entropy of the code points of a text, over its UTF-16 length."""
    return run_statistics(characters(text), total=utf16_length(text))["entropy"]


def character_entropy(text: Column) -> Column:
    """The same for long texts, most of whose characters are those of ASCII names.

    Taking a character out of a text shows how often it occurs, and leaves less text for the next
    one: with the frequent ones first, all name characters together cost about ten native passes.
    Whatever is left then is sorted, once, however many different characters it has. ``text`` should
    be a column of its own, as it is read several times.
    """
    size = utf16_length(text).cast("double")

    def take(acc: Column, ch: Column) -> Column:
        def less(rest: Column) -> Column:
            n = (F.octet_length(acc["rest"]) - F.octet_length(rest)).cast("double")  # the character is one byte
            return F.struct(rest.alias("rest"), (acc["weighed"] + n * F.log2(n)).alias("weighed"))

        return F.when(F.contains(acc["rest"], ch), bind(F.replace(acc["rest"], ch, F.lit("")), less)).otherwise(acc)

    def take_group(acc: Column, group: Column) -> Column:
        return F.when(F.octet_length(acc["rest"]) > 0, F.aggregate(group, acc, take)).otherwise(acc)

    start = F.struct(text.alias("rest"), F.lit(0.0).alias("weighed"))
    taken = F.aggregate(F.array(*(F.array(*map(F.lit, group)) for group in NAME_CHARACTERS)), start, take_group)

    def finish(acc: Column) -> Column:
        others = F.when(acc["rest"] != "", bind(run_lengths(F.sort_array(characters(acc["rest"]))), _weighed)).otherwise(0.0)
        return steady((F.length(text) * F.log2(size) - acc["weighed"] - others) / size)

    return F.when(text == "", F.lit(0.0)).otherwise(bind(taken, finish))


def masked(source: Column, literal: str = " ") -> Column:
    """The source with comments blanked out and literals made of ``literal``, all offsets and lines kept."""
    parts = F.regexp_extract_all(source, F.lit(f"(?:{MASK_PARTS})"), F.lit(0))
    blank = lambda part: (
        F.when(part.rlike(r"^(?://|/\*)"), F.regexp_replace(part, r"[^\n]", " "))
        .when(part.rlike("^[\"'`]"), F.regexp_replace(part, r"[^\n]", literal))
        .otherwise(part)
    )
    return F.array_join(F.transform(parts, blank), "")


def without_literals(source: Column) -> Column:
    """The source with each comment and literal reduced to one blank."""
    return F.regexp_replace(source, COMMENT_OR_LITERAL, " ")


def identifiers(code: Column) -> Column:
    """Identifier tokens in order, with repeats; an approximation without a syntax tree."""
    names = every(without_literals(code), NAME_LIKE)
    # names start with no digit ("0" to "9" sort right before ":")
    return F.filter(names, lambda n: ((n < "0") | (n >= ":")) & ~n.isin(*fixed.RESERVED_WORDS))


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def comment_lines(code: Column) -> Column:
    return hits(code, rf"(?:^|\n)[{fixed.WS_INLINE}]*(?://|/\*|\*)")


def code_lines(code: Column) -> Column:
    """Lines that are neither blank nor start like a comment."""
    return hits(code, rf"(?:^|\n)[{fixed.WS_INLINE}]*(?!//|/\*|\*)[^{fixed.WS}]")


def indents(code: Column) -> Column:
    """Leading white space of every line that is not blank."""
    led = F.regexp_extract_all(code, F.lit(rf"(?:^|\n)([{fixed.WS_INLINE}]*)[^{fixed.WS}]"), F.lit(1))
    return F.transform(led, lambda blank: F.length(blank))


def sentence_tokens(text: Column) -> Column:
    """Array of (tokens, solid) for every stretch between sentence ends; solid ones are not blank.

    Sentence ends are in no token, so all tokens of the text are here, in order.
    """
    parts = F.split(F.lower(text), r"[.!?;]+")
    split = lambda p: bind(every(p, WORD), lambda words: F.struct(
        words.alias("tokens"), ((F.size(words) > 0) | p.rlike(rf"[^{fixed.WS}]")).alias("solid"),
    ))
    return F.transform(parts, split)


def all_tokens(sentences: Column) -> Column:
    return F.flatten(F.transform(sentences, lambda s: s["tokens"]))


def sentence_statistics(sentences: Column) -> Column:
    """Array of (words, opener) for every sentence that is not blank."""
    return F.transform(
        F.filter(sentences, lambda s: s["solid"]),
        lambda s: F.struct(
            F.size(s["tokens"]).cast("bigint").alias("words"),
            F.coalesce(F.get(s["tokens"], F.lit(0)), F.lit("")).alias("opener"),
        ),
    )


def after_first(text: Column, pattern: str) -> Column:
    """What follows the first match of ``pattern``; empty when there is none."""
    return F.regexp_extract(text, f"(?s){pattern}(.*)", 1)


def in_order(text: Column, *patterns: str) -> Column:
    """True if the patterns occur one after the other.

    Equal to joining them with "anything" in one expression, but each step is a single
    forward pass, so a long text that misses the last pattern costs no backtracking.
    """
    rest = text
    for pattern in patterns[:-1]:
        rest = after_first(rest, pattern)
    return rest.rlike(patterns[-1])


def snippet(code: Column, max_lines: int = 8) -> Column:
    """First ``max_lines`` lines that are not blank, right-trimmed."""
    led = F.regexp_extract_all(
        F.regexp_replace(code, r"\r\n", "\n"), F.lit(rf"(?:^|\n)([^\n]*[^{fixed.WS}])"), F.lit(1)
    )
    return F.slice(led, 1, max(1, max_lines))
