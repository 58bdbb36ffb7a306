"""Shared pieces of the oracle statements."""

from __future__ import annotations

from inkprint import fixed
from inkprint.plans import rawjson, tables

WS = fixed.WS_PLAIN + fixed.WS_RARE
RE2 = lambda pattern: pattern.replace(fixed.WS, WS)
TYPES = {"b": "BIGINT", "s": "VARCHAR", "o": "BOOLEAN"}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def finish(body: str, spec: str) -> str:
    """``spec``: name and type letter (b bigint, d double, s text, o boolean), comma separated."""
    columns = []
    for entry in spec.split(","):
        name, kind = entry.split()
        if kind == "d":
            columns.append(f'round(cast("{name}" as double), 6) AS "{name}"')
        else:
            columns.append(f'cast("{name}" as {TYPES[kind]}) AS "{name}"')
    body = body.strip()
    if body.upper().startswith("WITH"):
        # the last top-level SELECT is marked by the caller
        head, tail = body.rsplit("--FINAL", 1)
        return f"{head} SELECT {', '.join(columns)} FROM ({tail}) AS final_rows"
    return f"SELECT {', '.join(columns)} FROM ({body}) AS final_rows"


def columns(mapping: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in mapping.items())


UNITS = f"units AS (SELECT {columns(tables.unit_columns('duckdb'))} FROM orders)"
FINDINGS = f"findings AS (SELECT *, {columns(tables.finding_columns('duckdb'))} FROM lineitem)"


def raw(template: str) -> str:
    return rawjson.text(template, "duckdb")


BARE = (
    r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
    r"|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|(?s:\\.))*`?"
)
RESERVED = "[" + ", ".join(q(w) for w in fixed.RESERVED_WORDS) + "]"
GENERIC = "[" + ", ".join(q(w) for w in fixed.GENERIC_NAMES) + "]"
TRIM = lambda x: f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def identifiers(code: str) -> str:
    return (
        f"list_filter(regexp_extract_all(regexp_replace({code}, {q(BARE)}, ' ', 'g'), '[A-Za-z0-9_$]+'), "
        f"lambda w: NOT regexp_matches(w, '^[0-9]') AND NOT list_contains({RESERVED}, w))"
    )


def entropy_cte(name: str, source: str, key: str, items: str, total: str = "sum(c)") -> str:
    """CTEs ``name``: key, n, distinct count, entropy of the listed items."""
    return f"""
{name}_items AS (SELECT {key} AS k, unnest({items}) AS item FROM {source}),
{name}_counts AS (SELECT k, item, count(*) AS c FROM {name}_items GROUP BY k, item),
{name}_sizes AS (SELECT k, sum(c) AS total FROM {name}_counts GROUP BY k),
{name} AS (
  SELECT k, sum(c) AS n, count(*) AS d, round(-sum(c / total * log2(c / total)), 9) AS h
  FROM {name}_counts JOIN {name}_sizes USING (k) GROUP BY k)"""


LINES = "string_split_regex(code, '\\r?\\n')"
CODE_LINES = (
    f"len(list_filter({LINES}, lambda l: regexp_matches(l, {q(f'[^{WS}]')}) "
    f"AND NOT regexp_matches(l, {q(f'^[{WS}]*(//|/[*]|[*])')})))"
)
COMMENT_LINES = f"len(list_filter({LINES}, lambda l: regexp_matches(l, {q(f'^[{WS}]*(//|/[*]|[*])')})))"
INDENTS = (
    f"list_transform(list_filter({LINES}, lambda l: regexp_matches(l, {q(f'[^{WS}]')})), "
    f"lambda l: length(regexp_extract(l, {q(f'^[{WS}]*')})))"
)
SENTENCES = (
    f"list_filter(string_split_regex(lower(code), '[.!?;]+'), lambda s: regexp_matches(s, {q(f'[^{WS}]')}))"
)


def count(pattern: str) -> str:
    return f"len(regexp_extract_all(code, {q(pattern)}))"


def has(pattern: str) -> str:
    return f"regexp_matches(code, {q(pattern)})"


def figures(source: str, key: str) -> str:
    """CTEs up to ``fig``: all figures of the rows of ``source`` (columns key, code, prefix)."""
    verbs = "|".join(fixed.OBVIOUS_COMMENT_VERBS)
    boiler = " + ".join(
        f"cast({has(p)} AS int)"
        for p in (
            rf"(?i)async[{WS}]+function[{WS}]+(get|create|update|delete)\w+",
            rf"(?is)try[{WS}]*\{{.*\}}[{WS}]*catch[{WS}]*\(error\)",
            r"(?i)res\.status\(\d{3}\)\.json",
            r"(?is)useState\([^)]*\).*useEffect",
        )
    )
    return f"""
lex AS (SELECT {key} AS k, code, prefix, {identifiers('code')} AS ids,
  {CODE_LINES} AS loc, {COMMENT_LINES} AS comment_lines, {INDENTS} AS indents, {SENTENCES} AS sentences,
  regexp_extract_all(lower(code), '[a-z0-9_]+') AS toks FROM {source}),
{entropy_cte('chars', 'lex', 'k', "regexp_extract_all(array_to_string(ids, ''), '(?s).')")},
{entropy_cte('words', 'lex', 'k', 'toks')},
sent AS (SELECT k, unnest(sentences) AS s FROM lex),
shape AS (SELECT k, len(regexp_extract_all(s, '[a-z0-9_]+')) AS words, regexp_extract(s, '[a-z0-9_]+') AS opener FROM sent),
burst AS (
  SELECT k, count(*) AS sentence_count, count(*) FILTER (words > 0) AS worded_count,
    coalesce(round(stddev_pop(words) FILTER (words > 0) / greatest(1, avg(words) FILTER (words > 0)), 9), 0) AS sentence_cv,
    coalesce(round(count(DISTINCT opener) FILTER (words > 0) / nullif(count(*) FILTER (words > 0), 0), 9), 0) AS opener_variety
  FROM shape GROUP BY k),
fig AS (
  SELECT lex.k, lex.ids, lex.loc, lex.comment_lines, lex.comment_lines / greatest(1, lex.loc + lex.comment_lines) AS comment_ratio,
    len(ids) AS ident_count, len(list_filter(ids, lambda w: list_contains({GENERIC}, lower(w)))) AS ident_generic,
    coalesce(chars.h, 0) AS ident_entropy,
    len(indents) AS indent_lines, len(list_distinct(indents)) AS indent_levels,
    regexp_matches(prefix, {q(rf'(?s)/[*][*].*?[*]/[{WS}]*$')}) AS has_doc,
    {has(rf'(?i)//[{WS}]*({verbs})' + chr(92) + 'b')} AS obvious_comment,
    {has('(?s)' + RE2(fixed.EMPTY_CATCH))} AS empty_catch,
    {count(RE2(fixed.NULL_CHECKS))} AS null_checks, {boiler} AS boilerplate_hits,
    {count(RE2(fixed.HELPER_DEFINITIONS))} AS helper_definitions,
    {has(r'(?is)validate\w*\([^)]*\).*format\w*\([^)]*\).*process\w*\([^)]*\)')} AS helper_sequence,
    {has(fixed.EMOJI)} AS emoji,
    coalesce(words.n, 0) AS token_count, coalesce(words.h, 0) AS token_entropy, coalesce(words.d, 0) AS token_distinct,
    round(1 - coalesce(words.d, 0) / greatest(1, coalesce(words.n, 0)), 9) AS token_repetition0,
    coalesce(sentence_count, 0) AS sentence_count, coalesce(worded_count, 0) AS worded_count,
    coalesce(sentence_cv, 0) AS sentence_cv, coalesce(opener_variety, 0) AS opener_variety
  FROM lex LEFT JOIN chars ON lex.k = chars.k LEFT JOIN words ON lex.k = words.k LEFT JOIN burst ON lex.k = burst.k)"""


SHORT = {
    "genericNames": "g1", "commentRatio": "g2", "obviousComments": "g3", "emptyCatch": "g4", "nullChecks": "g5",
    "formattingUniformity": "g6", "universalJsdoc": "g7", "namingEntropy": "g8", "boilerplatePatterns": "g9",
    "helperOrdering": "g10", "emojiComments": "g11", "perplexity": "g12", "burstiness": "g13",
}


def rnd(x: str) -> str:
    return f"cast(floor(cast({x} AS double) + 0.5) AS bigint)"


def scores(weights: dict[str, int] | None = None, threshold: int = 9, keep: str = "") -> str:
    """CTE ``scored`` on top of ``fig``: g1..g13, points, score, flagged, band."""
    w = {**fixed.SIGNAL_WEIGHTS, **(weights or {})}
    c01 = lambda x: f"greatest(0.0, least(1.0, {x}))"
    raw_scores = {
        "genericNames": f"ident_generic / greatest(1, ident_count) * {w['genericNames']} * 3",
        "commentRatio": f"CASE WHEN comment_ratio >= 0.4 THEN {w['commentRatio']} ELSE comment_ratio / 0.4 * {w['commentRatio']} END",
        "obviousComments": f"CASE WHEN obvious_comment THEN {w['obviousComments']} ELSE 0 END",
        "emptyCatch": f"CASE WHEN empty_catch THEN {w['emptyCatch']} ELSE 0 END",
        "nullChecks": f"least({w['nullChecks']}, null_checks * 2)",
        "formattingUniformity": f"CASE WHEN indent_levels <= 3 AND indent_lines > 8 THEN {w['formattingUniformity']} ELSE {w['formattingUniformity']} * 0.2 END",
        "universalJsdoc": f"CASE WHEN has_doc THEN {w['universalJsdoc']} ELSE 0 END",
        "namingEntropy": f"CASE WHEN ident_entropy < 3.2 THEN {w['namingEntropy']} WHEN ident_entropy < 3.8 THEN {w['namingEntropy']} * 0.5 ELSE 0 END",
        "boilerplatePatterns": f"boilerplate_hits * {w['boilerplatePatterns'] / 2}",
        "helperOrdering": f"CASE WHEN helper_definitions >= 2 OR helper_sequence THEN {w['helperOrdering']} ELSE 0 END",
        "emojiComments": f"CASE WHEN emoji THEN {w['emojiComments']} ELSE 0 END",
        "perplexity": (
            f"CASE WHEN token_count < 8 THEN 0 ELSE round({w['perplexity']} * " + c01(
                "(1 - " + c01("(token_entropy - 2.2) / 2.2") + ") * 0.75 + " + c01("token_repetition0") + " * 0.25"
            ) + ", 9) END"
        ),
        "burstiness": (
            f"CASE WHEN sentence_count < 3 OR worded_count < 3 THEN 0 ELSE round({w['burstiness']} * (0.7 * "
            + c01("(0.55 - sentence_cv) / 0.55") + " + 0.3 * " + c01("(0.75 - opener_variety) / 0.75") + "), 9) END"
        ),
    }
    cols = ", ".join(
        f"greatest(0, least({w[n]}, {rnd(expr)})) AS {SHORT[n]}" for n, expr in raw_scores.items()
    )
    points = " + ".join(SHORT.values())
    return f"""
sig AS (SELECT *, {cols} FROM fig),
tot AS (SELECT *, {points} AS points, {rnd(f'({points}) / {float(sum(w.values()))} * 100')} AS score FROM sig),
scored AS (SELECT *, score >= {threshold} AS flagged,
  CASE WHEN score < 40 THEN 'LOW' WHEN score < 70 THEN 'UNCERTAIN' ELSE 'HIGH' END AS band FROM tot)"""


UNIT_FIGURES = f"{UNITS}, {figures('units', 'unit_key')}"
DOCS = "docs AS (SELECT doc_id, source, text AS code, '' AS prefix FROM documents)"
DOC_FIGURES = f"{DOCS}, {figures('docs', 'doc_id')}"
UNIT_SCORES = f"{UNIT_FIGURES}, {scores()}"
DOC_SCORES = f"{DOC_FIGURES}, {scores()}"
# scored rows next to their unit
LOCATED = f"{UNIT_SCORES}, located AS (SELECT scored.*, units.* EXCLUDE (code, prefix), units.code FROM scored JOIN units ON scored.k = units.unit_key)"
RISK = "CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
FOLDER = "CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) ELSE '<root>' END"
