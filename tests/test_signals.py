"""Hand-worked values of the signals and the score."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint import merge_config
from inkprint.functions import scalars as sx
from inkprint.functions import text as tx
from inkprint.operators import score as sc
from inkprint.operators import signals as sg
from inkprint.operators import units as un


def scored(spark, *codes, prefix="", config=None):
    rows = [(i, code, prefix) for i, code in enumerate(codes)]
    df = sc.score_units(spark.createDataFrame(rows, "no int, code string, prefix string"), config or merge_config())
    return df.orderBy("no")


def one(spark, code, *columns, prefix=""):
    row = scored(spark, code, prefix=prefix).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_generic_names_ratio_times_three(spark):
    # 1 of 4 names: 0.25 * 15 * 3 = 11.25
    assert one(spark, "alpha beta gamma data", "s_genericNames") == 11
    # always capped by the weight
    assert one(spark, "data Result VALUE", "s_genericNames") == 15


def test_comment_ratio(spark):
    # 1 comment line, 3 code lines: 0.25 / 0.4 * 12 = 7.5, halves upwards
    assert one(spark, "// a\nx\ny\nz", "comment_lines", "loc", "s_commentRatio") == (1, 3, 8)
    assert one(spark, "/* a\n * b\n */\nx", "comment_lines", "loc", "s_commentRatio") == (3, 1, 12)
    # the line that opens with */ is a comment even with code behind it
    assert one(spark, "*/ x\r\ny", "comment_lines", "loc") == (1, 1)


@pytest.mark.parametrize(
    ("code", "hit"),
    [
        ("// Fetch the data", True), ("//set it", True), ("// getter", False), ("// get_it", False),
        ("// geté", True),  # word ends are ASCII
        ("// now get", False),
    ],
)
def test_obvious_comments(spark, code, hit):
    assert one(spark, code, "s_obviousComments") == (10 if hit else 0)


@pytest.mark.parametrize(
    ("code", "hit"),
    [
        ("catch (e) {}", True), ("catch(e){ \n }", True), ("catch (e) { console.error(e); }", True),
        ("catch (e) { console.log(e)\n}", False), ("catch (e) { throw e; }", False), ("catch {}", False),
    ],
)
def test_empty_catch(spark, code, hit):
    assert one(spark, code, "s_emptyCatch") == (10 if hit else 0)


def test_null_checks(spark):
    assert one(spark, "a ?? b; c?.d; typeof x === 'undefined'; y === null; z !== null", "null_checks", "s_nullChecks") == (5, 8)
    assert one(spark, "a ?? b", "s_nullChecks") == 2


def test_formatting_is_never_zero(spark):
    assert one(spark, "x", "s_formattingUniformity") == 2
    assert one(spark, "\n".join(["  x"] * 9), "s_formattingUniformity") == 8
    assert one(spark, "\n".join(["  x"] * 8), "s_formattingUniformity") == 2
    assert one(spark, "\n".join(" " * (i % 4) + "x" for i in range(9)), "indent_levels", "s_formattingUniformity") == (4, 2)


def test_doc_comment(spark):
    assert one(spark, "x", "s_universalJsdoc", prefix="/** a */\n") == 7
    assert one(spark, "x", "s_universalJsdoc", prefix="/** a */ y") == 0
    assert one(spark, "x", "s_universalJsdoc", prefix="/* a */") == 0


def entropy(text):
    counts = Counter(text)
    n = sum(len(c.encode("utf-16-be")) // 2 * k for c, k in counts.items())
    return -sum(k / n * math.log2(k / n) for k in counts.values())


def test_naming_entropy(spark):
    assert one(spark, "", "ident_entropy", "s_namingEntropy") == (0.0, 10)
    joined = "alphabravocharlie"
    got, points = one(spark, "alpha = bravo + charlie", "ident_entropy", "s_namingEntropy")
    assert got == pytest.approx(entropy(joined), abs=1e-8)
    assert points == (10 if entropy(joined) < 3.2 else 5)


def test_character_entropy_counts_utf16_and_large_alphabets(spark):
    wide = "".join(chr(0x4E00 + i) for i in range(400)) + "aab"
    long = "".join(chr(0x4E00 + i * i % 5000) + "xY_9"[i % 4] for i in range(200_000))  # a megabyte, thousands of characters
    rows = [("a\U0001F680a",), ("",), (wide,), ("aaaa",), (long,), ("é" * 9 + "$",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", tx.character_entropy(F.col("t")), tx.short_text_entropy(F.col("t"))).collect()
    for text, long_form, short_form in got:
        want = entropy(text) if text else 0.0
        assert long_form == pytest.approx(want, abs=1e-8) and short_form == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("text", ["", " ", "a", "a b. c; ! ?\n.x", "İ Kelvin K. ...", ".;a.;", "one two. three", "\u00a0.\u00a0x"])
def test_tokens_of_sentences_are_those_of_the_text(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", tx.sentence_tokens(F.col("t")))
    row = df.select(tx.all_tokens(F.col("s")), tx.tokens(F.col("t")), F.size(tx.sentence_statistics(F.col("s")))).first()
    assert row[0] == row[1]
    assert row[2] == sum(bool(p.strip()) for p in re.split(r"[.!?;]+", text))


def test_lines_of_code_are_the_lines_that_are_no_comments(spark):
    rows = [(t, "") for t in ("", "\n \n", "a\n // b\n\t* c\n/* d\n  e /* f", "/\n//\n*x\n / *\r\n\x0c\n\u00a0q", "\r\n\r x")]
    df = spark.createDataFrame(rows, "code string, prefix string")
    assert all(a == b for a, b in sg.figures(df).select("loc", tx.code_lines(F.col("code"))).collect())


def test_boilerplate_and_order(spark):
    assert one(spark, "async function getX() {}", "s_boilerplatePatterns") == 5
    assert one(spark, "try { a } catch (error) { b }", "s_boilerplatePatterns") == 5
    assert one(spark, "} catch (error) try {", "s_boilerplatePatterns") == 0
    assert one(spark, "useState(1)\nuseEffect; res.status(404).json", "boilerplate_hits") == 2
    assert one(spark, "useEffect useState(1)", "boilerplate_hits") == 0
    assert one(spark, "function validateA() {} function HandleB() {}", "s_helperOrdering") == 10
    assert one(spark, "validateA(x)\nformatB(y)\nprocess(z)", "s_helperOrdering") == 10
    assert one(spark, "process(z); validateA(x); formatB(y)", "s_helperOrdering") == 0


@pytest.mark.parametrize(("code", "hit"), [("\U0001F680", True), ("☀", True), ("➿", True), ("─", False), ("\U0001F2FF", False)])
def test_emoji(spark, code, hit):
    assert one(spark, code, "s_emojiComments") == (10 if hit else 0)


def test_perplexity(spark):
    assert one(spark, "a b c d e f g", "s_perplexity") == 0  # below eight tokens
    # one token eight times: entropy 0, spread 0, repetition 7/8
    assert one(spark, "x " * 8, "token_entropy", "token_repetition", "s_perplexity") == (0.0, 0.875, 12)
    # 32 different tokens: entropy 5, spread 1, repetition 0
    assert one(spark, " ".join(f"t{i}" for i in range(32)), "token_entropy", "s_perplexity") == (5.0, 0)


def test_burstiness(spark):
    assert one(spark, "a. b.", "s_burstiness") == 0
    # three sentences alike: cv 0, openers 1/3 -> 12 * (0.7 + 0.3 * (0.75 - 1/3) / 0.75) = 10.4
    assert one(spark, "go on. go on! go on?", "sentence_cv", "s_burstiness") == (0.0, 10)
    # a blank-free sentence without a word counts as sentence only
    assert one(spark, "a; +; b", "sentence_count", "worded_count", "s_burstiness") == (3, 2, 0)


def test_total_band_and_explanation(spark):
    row = scored(spark, "count(count, count);\n" * 4, prefix="/** d */").select(
        "points", "score", "band", sc.explained().alias("e"), sc.signal_array().alias("s")
    ).first()
    assert row["score"] == math.floor(row["points"] / 134 * 100 + 0.5)
    values = [s["score"] for s in row["s"]]
    assert len(values) == 13 and sum(values) == row["points"]
    mean = sum(values) / 13
    assert row["e"]["variance"] == math.floor(sum((v - mean) ** 2 for v in values) / 13 + 0.5)
    ranked = sorted((s for s in row["s"] if s["score"] > 0), key=lambda s: -s["score"])[:3]
    assert [t["signal"] for t in row["e"]["top_signals"]] == [s["signal"] for s in ranked]
    assert row["e"]["signals_triggered"] == sum(v > 0 for v in values)
    assert row["s"][5]["evidence"] == "1 indentation levels"


def test_weights_and_threshold(spark):
    config = merge_config(threshold=42, weights={"genericNames": 99, "commentRatio": 3})
    row = scored(spark, "data data data", config=config).select("s_genericNames", "points", "score", "flagged").first()
    assert row["s_genericNames"] == 99
    total = 134 - 15 - 12 + 99 + 3
    assert row["score"] == math.floor(row["points"] / total * 100 + 0.5) and row["flagged"] == (row["score"] >= 42)


def test_columns_of_a_real_parser_are_used(spark):
    df = spark.createDataFrame([("x y", "", ["data"], 5, 5)], "code string, prefix string, identifiers array<string>, loc int, comment_lines int")
    row = sc.score_units(df).select("s_genericNames", "s_commentRatio").first()
    assert tuple(row) == (15, 12)


@pytest.mark.parametrize(("x", "want"), [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0), (7.0, 7)])
def test_half_up(spark, x, want):
    assert spark.range(1).select(sx.half_up(F.lit(x))).first()[0] == want


def test_clamp_and_decimals(spark):
    row = spark.range(1).select(
        sx.clamp01(F.lit(-0.1)), sx.clamp01(F.lit(1.5)), sx.clamp01(F.lit(0.3)), sx.one_decimal(F.lit(1.25)),
        sx.one_decimal(F.lit(-1.25)), sx.clamp(F.lit(9.0), 0.0, 8.0),
    ).first()
    assert tuple(row) == (0.0, 1.0, 0.3, 1.3, -1.2, 8.0)


def test_listing(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "no int, flagged boolean")
    assert sc.listed_units(df).count() == 1 and sc.listed_units(df, verbose=True).count() == 2


def test_snippet(spark):
    code = "a  \r\n\n  b\t\n   \nc\nd"
    got = spark.createDataFrame([(code,)], "c string").select(tx.snippet(F.col("c"), 3)).first()[0]
    assert got == ["a", "  b", "c"]


def test_nesting_and_complexity(spark):
    code = """function f(a) {
  for (let i = 0; i < 3; i++) {
    if (a && i || a ?? 1) { while (true) { g(); } }
  }
  // if (x) { if (y) {} }
  switch (a) { case 1: break; case 2: break; }
  a ??= 3;
}"""
    row = spark.createDataFrame([(code,)], "c string").select(un.nesting_depth(F.col("c")), un.complexity(F.col("c"))).first()
    assert row[0] == 3
    # 1 + for + if + && + || + ?? + while + two cases
    assert row[1] == 9


def test_fingerprint_case_mix(spark):
    names = spark.createDataFrame([(["camelCase", "snake_case", "PascalCase", "plain", "CONST"],)], "n array<string>")
    row = names.select(*[c.alias(k) for k, c in sc.case_mix(F.col("n")).items()]).first()
    assert row.asDict() == {"camel_names": 1, "snake_names": 1, "pascal_names": 1}


def test_signal_names_are_the_weights():
    assert [s.name for s in sg.SIGNALS] == list(merge_config().weights)


def test_plain_searches_before_patterns_change_nothing(spark):
    """Lines of prose meet no pattern: a plain search comes first, and finds all that the patterns find."""
    texts = ["ASYNC Function Create1()", "tRy {} x } Catch (error)", "RES.status(200).JSON", "usestate(1) USEEFFECT", "// Get it", "catch (e) { }", "a ?? b?.c",
             "typeof x === 'undefined'", "x !== null", "FUNCTION validateA FUNCTION format", "Validate(a) FORMAT(b) proceSS(c)", "\U0001F680 up", "été", "prose", ""]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "code string").withColumn("_low", F.lower("code"))
    code = F.col("code")
    plain = {
        "obvious_comment": code.rlike(sg._OBVIOUS), "empty_catch": code.rlike(f"(?s){fixed.EMPTY_CATCH}"), "null_checks": tx.hits(code, fixed.NULL_CHECKS),
        "boilerplate_hits": sum((tx.in_order(code, *p).cast("int") for _, *p in sg._BOILERPLATE), F.lit(0)),
        "helper_definitions": tx.hits(code, fixed.HELPER_DEFINITIONS), "helper_sequence": tx.in_order(code, *sg._HELPER_CALLS), "emoji": code.rlike(fixed.EMOJI),
    }
    for name, figure in sg._pattern_figures(F.col("_low")).items():
        got = df.select("code", figure.alias("a"), plain[name].alias("b"))
        assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0, name
        assert got.filter("b").count() if got.dtypes[2][1] == "boolean" else got.filter("b > 0").count(), name
