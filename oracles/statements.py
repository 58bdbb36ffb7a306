"""One statement per registered query."""

from __future__ import annotations

from inkprint import fixed
from inkprint.plans import queries as qs
from inkprint.plans import rawjson, tables
from oracles.base import (
    BARE, RE2, COMMENT_LINES, CODE_LINES, DOC_FIGURES, DOC_SCORES, DOCS, FINDINGS, FOLDER, INDENTS, LINES, LOCATED,
    RISK, SENTENCES, SHORT, TRIM, UNIT_FIGURES, UNIT_SCORES, UNITS, WS, entropy_cte, figures, finish, identifiers,
    q, raw, rnd, scores,
)

ORACLES: dict[str, str] = {}


def oracle(name: str, spec: str, body: str) -> None:
    ORACLES[name] = finish(body, spec)


B = chr(92)

# --- signals -------------------------------------------------------------------------------

oracle("sig_perplexity", "doc_id b, token_count b, token_entropy d, token_repetition d, score b",
       f"WITH {DOC_SCORES} --FINAL SELECT k AS doc_id, token_count, token_entropy, token_repetition0 AS token_repetition, g12 AS score FROM scored")
oracle("sig_burstiness", "doc_id b, sentence_count b, worded_count b, sentence_cv d, opener_variety d, score b",
       f"WITH {DOC_SCORES} --FINAL SELECT k AS doc_id, sentence_count, worded_count, sentence_cv, opener_variety, g13 AS score FROM scored")
oracle("sig_comment_ratio", "unit_key b, loc b, comment_lines b, comment_ratio d, score b",
       f"WITH {UNIT_SCORES} --FINAL SELECT k AS unit_key, loc, comment_lines, comment_ratio, g2 AS score FROM scored")
oracle("sig_generic_names", "unit_key b, ident_count b, ident_generic b, score b",
       f"WITH {UNIT_SCORES} --FINAL SELECT k AS unit_key, ident_count, ident_generic, g1 AS score FROM scored")
oracle("sig_naming_entropy", "unit_key b, ident_entropy d, score b",
       f"WITH {UNIT_SCORES} --FINAL SELECT k AS unit_key, ident_entropy, g8 AS score FROM scored")
oracle("sig_formatting", "unit_key b, indent_lines b, indent_levels b, score b",
       f"WITH {UNIT_SCORES} --FINAL SELECT k AS unit_key, indent_lines, indent_levels, g6 AS score FROM scored")
oracle("sig_regex_family",
       "unit_key b, null_checks b, helper_definitions b, boilerplate_hits b, obviouscomments b, emptycatch b, nullchecks b, "
       "universaljsdoc b, boilerplatepatterns b, helperordering b, emojicomments b",
       f"WITH {UNIT_SCORES} --FINAL SELECT k AS unit_key, null_checks, helper_definitions, boilerplate_hits, g3 AS obviouscomments, "
       "g4 AS emptycatch, g5 AS nullchecks, g7 AS universaljsdoc, g9 AS boilerplatepatterns, g10 AS helperordering, "
       "g11 AS emojicomments FROM scored")
_TRIGGERED = " + ".join(f"cast({g} > 0 AS int)" for g in SHORT.values())
_VALUES = "[" + ", ".join(SHORT.values()) + "]"
oracle("score_units", "unit_key b, points b, score b, flagged o, band s, signals_triggered b, variance b",
       f"WITH {UNIT_SCORES} --FINAL SELECT k AS unit_key, points, score, flagged, band, {_TRIGGERED} AS signals_triggered, "
       f"{rnd(f'list_aggregate(list_transform({_VALUES}, lambda g: cast(g AS double)), {q('var_pop')})')} AS variance FROM scored")
oracle("score_documents", "doc_id b, " + ", ".join(f"s_{n.lower()} b" for n in SHORT) + ", points b, score b, flagged o, band s",
       f"WITH {DOC_SCORES} --FINAL SELECT k AS doc_id, " + ", ".join(f"{g} AS s_{n.lower()}" for n, g in SHORT.items())
       + ", points, score, flagged, band FROM scored")
_SIGNAL_ROWS = " UNION ALL ".join(
    f"SELECT k, points, {i} AS ord, '{n}' AS signal, {g} AS g FROM scored" for i, (n, g) in enumerate(SHORT.items())
)
oracle("top_signals", "unit_key b, place b, signal s, contribution b, score b", f"""WITH {UNIT_SCORES}, long AS ({_SIGNAL_ROWS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g DESC, ord) AS place FROM long WHERE g > 0)
--FINAL SELECT k AS unit_key, place, signal, {rnd('g / points * 100')} AS contribution, g AS score FROM ranked WHERE place <= 3""")
_TWO = lambda x: f"printf('%.2f', {x} + 1e-9)"  # noqa: E731  exact ties go up
oracle("signal_evidence", "unit_key b, " + ", ".join(f"{n.lower()} s" for n in qs.EVIDENCE), f"""WITH {UNIT_FIGURES}
--FINAL SELECT k AS unit_key, ident_generic || '/' || ident_count || ' identifiers are generic' AS genericnames,
CASE WHEN obvious_comment THEN 'obvious explanatory comment found' ELSE 'no obvious comments' END AS obviouscomments,
CASE WHEN empty_catch THEN 'empty or log-only catch block' ELSE 'catch blocks include handling' END AS emptycatch,
null_checks || ' defensive null/undefined checks' AS nullchecks, indent_levels || ' indentation levels' AS formattinguniformity,
CASE WHEN has_doc THEN 'JSDoc present' ELSE 'no JSDoc' END AS universaljsdoc, boilerplate_hits || ' boilerplate patterns' AS boilerplatepatterns,
helper_definitions || ' helper-like definitions' AS helperordering,
CASE WHEN emoji THEN 'emoji-like character found' ELSE 'no emoji comments' END AS emojicomments,
'comment ratio ' || {_TWO('comment_ratio')} AS commentratio, 'identifier entropy ' || {_TWO('ident_entropy')} AS namingentropy,
CASE WHEN token_count < 8 THEN 'insufficient tokens for perplexity estimate'
 ELSE 'token entropy ' || {_TWO('token_entropy')} || ', repetition ' || {rnd('token_repetition0 * 100')} || '%' END AS perplexity,
CASE WHEN sentence_count < 3 THEN 'insufficient sentence count for burstiness estimate' WHEN worded_count < 3 THEN 'insufficient tokenized sentences for burstiness estimate'
 ELSE 'sentence cv ' || {_TWO('sentence_cv')} || ', opener variety ' || {rnd('opener_variety * 100')} || '%' END AS burstiness FROM fig""")
oracle("weight_override", "unit_key b, generic_names b, comment_points b, points b, score b, flagged o",
       f"WITH {UNIT_FIGURES}, {scores({'genericNames': 99, 'commentRatio': 3}, 42)} --FINAL "
       "SELECT k AS unit_key, g1 AS generic_names, g2 AS comment_points, points, score, flagged FROM scored")
oracle("flagged_units", "unit_key b, path s, name s, score b",
       f"WITH {LOCATED} --FINAL SELECT unit_key, path, name, score FROM located WHERE score >= 20")

# --- unit features ---------------------------------------------------------------------------

_UNIT_ID = "substring(sha1(path || ':' || start_line || ':' || end_line || ':' || name), 1, 12)"
oracle("unit_features", "unit_key b, id s, loc b, comment_lines b, comment_ratio d, has_doc o, snippet s", f"""WITH {UNITS},
f AS (SELECT *, {CODE_LINES} AS loc, {COMMENT_LINES} AS comment_lines FROM units)
--FINAL SELECT unit_key, {_UNIT_ID} AS id, loc, comment_lines, comment_lines / greatest(1, loc + comment_lines) AS comment_ratio,
prefix <> '' AS has_doc,
array_to_string(list_filter(list_transform({LINES}, lambda l: regexp_replace(l, {q(f'[{WS}]+$')}, '')), lambda l: l <> '')[1:3], '|') AS snippet
FROM f WHERE loc >= 3""")
_CODE = f"regexp_replace(code, {q(BARE)}, ' ', 'g')"
_OPS = f"replace(replace(replace({_CODE}, '??=', ' '), '||=', ' '), '&&=', ' ')"
_NEST = f"""list_reduce(list_prepend({{'t': '', 'open': '', 'wait': 0, 'best': 0}}, list_transform(
  regexp_extract_all(regexp_replace({_CODE}, '{B}bfor{B}s*{B}([^(){{}}]*{B})', 'for ', 'g'), '{B}b(?:if|for|while|switch|try){B}b|[{{}};]'),
  lambda x: {{'t': x, 'open': '', 'wait': 0, 'best': 0}})),
  lambda s, x: {{'t': x.t,
    'open': CASE WHEN x.t = '{{' AND s.wait > 0 THEN s.open || repeat('c', s.wait) WHEN x.t = '{{' THEN s.open || 'o'
      WHEN x.t = '}}' THEN left(s.open, greatest(0, length(s.open) - 1)) ELSE s.open END,
    'wait': CASE WHEN x.t IN ('{{', '}}', ';') THEN 0 ELSE s.wait + 1 END,
    'best': CASE WHEN x.t IN ('{{', '}}', ';') THEN s.best
      ELSE greatest(s.best, length(replace(s.open, 'o', '')) + s.wait + 1) END}}).best"""
oracle("lexical_complexity", "unit_key b, complexity b, nesting_depth b, parameters s, identifiers s", f"""WITH {UNITS}
--FINAL SELECT unit_key, 1 + len(regexp_extract_all({_OPS}, '{B}b(?:if|for|while|case){B}b|{B}?{B}?|{B}|{B}||&&')) AS complexity,
{_NEST} AS nesting_depth,
array_to_string(list_transform(list_filter(string_split(regexp_extract({_CODE}, '^[^({{]*{B}(((?:[^()]|{B}([^()]*{B}))*){B})', 1), ','),
  lambda p: regexp_matches(p, '[A-Za-z_$]')), lambda p: regexp_extract(p, '[A-Za-z_$][A-Za-z0-9_$]*')), ',') AS parameters,
array_to_string({identifiers('code')}, ' ') AS identifiers FROM units""")
# What the splitter has to find is known from the templates: (template, kind, name, first line, last line).
_KNOWN = [
    (0, "function", "settleLedger{k}", 0, 6), (1, "function", "getData{k}", 0, 8), (2, "function", "handleReq", 0, 5),
    (3, "arrow", "Panel{k}", 0, 5), (5, "function", "loadAll{k}", 0, 5), (6, "function", "connect{k}", 0, 4),
    (7, "function", "login{k}", 0, 4), (8, "function", "a{k}", 3, 10), (9, "function", "total", 0, 4),
    (11, "class", "Box{k}", 0, 5), (11, "method", "open", 1, 3),
]
_KNOWN_ROWS = ", ".join(f"({t}, '{k}', '{n}', {a}, {b})" for t, k, n, a, b in _KNOWN)
oracle("lexical_units", "path s, name s, kind s, start_line b, end_line b, id s, code_sha s", f"""WITH {UNITS},
known(t, kind, name, a, b) AS (VALUES {_KNOWN_ROWS}),
found AS (SELECT u.path, replace(known.name, '{{k}}', cast(u.unit_key AS varchar)) AS name, known.kind,
  u.start_line + a AS start_line, u.start_line + b AS end_line,
  array_to_string(string_split(u.code, chr(10))[a + 1:b + 1], chr(10)) AS body FROM units u JOIN known ON u.unit_key % 12 = known.t)
--FINAL SELECT path, name, kind, start_line, end_line, {_UNIT_ID} AS id,
sha1(CASE WHEN kind = 'arrow' THEN regexp_replace(body, '^const [A-Za-z0-9]+ = |;$', '', 'g') ELSE regexp_replace(body, '^  open', 'open') END) AS code_sha FROM found""")
# The same for views: (template, kind, name, first line, last line, characters before the first and after the last).
_KNOWN_VIEWS = [
    (0, "arrow", "List{k}", 0, 8, "export const List{k} = ", ";"), (0, "arrow", "<anonymous>", 2, 6, "    {rows.map(", ")}"),
    (1, "arrow", "scale{k}", 0, 3, "const scale{k} = ", ""), (1, "arrow", "<anonymous>", 0, 3, "const scale{k} = (rate) => ", ""),
    (2, "arrow", "load{k}", 0, 6, "export const load{k} = ", ";"), (2, "arrow", "<anonymous>", 3, 6, "    .map(", ");"),
    (2, "arrow", "open", 8, 10, "  open: ", ","), (2, "method", "close", 11, 14, "  ", ","),
    (3, "arrow", "<anonymous>", 0, 3, "register({k}, ", ","), (3, "arrow", "<anonymous>", 7, 11, "  ", ");"),
]
_KNOWN_VIEW_ROWS = ", ".join(f"({t}, '{k}', '{n}', {a}, {b}, '{x}', '{y}')" for t, k, n, a, b, x, y in _KNOWN_VIEWS)
_VIEWS = ", ".join(f"{sql} AS {name}" for name, sql in tables.view_columns("duckdb").items())
oracle("expression_units", "path s, name s, kind s, start_line b, end_line b, id s, code s", f"""WITH views AS (SELECT o_orderkey AS k, {_VIEWS} FROM orders),
known(t, kind, name, a, b, x, y) AS (VALUES {_KNOWN_VIEW_ROWS}),
found AS (SELECT path, replace(known.name, '{{k}}', cast(k AS varchar)) AS name, known.kind, a + 1 AS start_line, b + 1 AS end_line,
  array_to_string(string_split(content, chr(10))[a + 1:b + 1], chr(10)) AS body, length(replace(x, '{{k}}', cast(k AS varchar))) AS lead, length(y) AS tail
  FROM views JOIN known ON k % 4 = known.t)
--FINAL SELECT path, name, kind, start_line, end_line, {_UNIT_ID} AS id, substring(body, lead + 1, length(body) - lead - tail) AS code FROM found""")
oracle("distinct_counts", "doc_id b, words b, indents b, openers b", f"""WITH {DOCS}
--FINAL SELECT doc_id, len(list_distinct(regexp_extract_all(lower(code), '[a-z0-9_]+'))) AS words, len(list_distinct({INDENTS})) AS indents,
len(list_distinct(list_transform({SENTENCES}, lambda s: regexp_extract(s, '[a-z0-9_]+')))) AS openers FROM docs""")

# --- detectors -----------------------------------------------------------------------------------

_CALLS = " UNION ALL ".join(
    f"SELECT unit_key, path, start_line, score, flagged, {i} AS r, '{api}' AS rule, unnest(regexp_extract_all(code, {q(B + 'b' + RE2(pat))})) AS m, "
    f"generate_subscripts(regexp_extract_all(code, {q(B + 'b' + RE2(pat))}), 1) AS pos FROM located"
    for i, (api, pat) in enumerate(fixed.INVALID_CALLS.items())
)
oracle("invalid_api_findings",
       "unit_key b, match_no b, id s, severity s, file s, line b, code s, message s, ai_score b, rule_id s", f"""WITH {LOCATED}, calls AS ({_CALLS})
--FINAL SELECT unit_key, row_number() OVER (PARTITION BY unit_key ORDER BY r, pos) - 1 AS match_no,
substring(sha1('hallucination:' || path || ':' || start_line || ':' || m), 1, 10) AS id,
CASE WHEN score >= 65 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, path AS file, start_line AS line, m AS code,
rule || ' is not part of the known API surface.' AS message, score AS ai_score, 'hallucination.invalid-api-call' AS rule_id FROM calls WHERE flagged""")


def _secret_rows(source: str, key: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {key} AS k{extra}, '{rule}' AS rule, unnest(regexp_extract_all(code, {q(pat)})) AS m FROM {source}"
        for rule, pat in fixed.SECRET_RULES.items()
    )


def _random_ctes(source: str, key: str, extra: str = "") -> str:
    """``lits`` (numbered literals) and ``random_lits`` (those that look random, with entropy)."""
    return f"""raw_lits AS (SELECT {key} AS k{extra}, unnest(regexp_extract_all(code, {q(fixed.LITERAL)})) AS quoted FROM {source}),
lits AS (SELECT *, substring(quoted, 2, length(quoted) - 2) AS literal, row_number() OVER () AS lit_no FROM raw_lits),
{entropy_cte('lit', 'lits', 'lit_no', "regexp_extract_all(literal, '(?s).')")},
random_lits AS (SELECT lits.*, lit.h FROM lits JOIN lit ON lits.lit_no = lit.k
  WHERE NOT regexp_matches(literal, {q(fixed.HARMLESS_LITERAL)})
  AND (regexp_matches(literal, {q(fixed.HEX_LITERAL)}) OR (length(literal) > 20 AND lit.h > 4.5)))"""


_AT = ", path, start_line, score"
oracle("secret_findings", "unit_key b, id s, severity s, file s, line b, code s, ai_score b, rule_id s", f"""WITH {LOCATED},
{_random_ctes('located', 'unit_key', _AT)},
hits AS ({_secret_rows('located', 'unit_key', _AT)} UNION ALL SELECT k{_AT}, 'high-entropy-literal', literal FROM random_lits)
--FINAL SELECT k AS unit_key, substring(sha1('secret:' || rule || ':' || path || ':' || start_line || ':' || m), 1, 10) AS id,
CASE WHEN score >= 65 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, path AS file, start_line AS line, m AS code, score AS ai_score,
'secret.' || rule AS rule_id FROM hits""")
oracle("document_secrets", "doc_id b, rule s, hits b", f"""WITH {DOCS}, {_random_ctes('docs', 'doc_id')},
hits AS ({_secret_rows('docs', 'doc_id')} UNION ALL SELECT k, 'high-entropy-literal', literal FROM random_lits)
--FINAL SELECT k AS doc_id, rule, count(*) AS hits FROM hits GROUP BY k, rule""")
oracle("entropy_literals", "doc_id b, literal s, entropy d", f"""WITH {UNITS},
every_text AS (SELECT doc_id AS k0, text AS code FROM documents UNION ALL SELECT unit_key, code FROM units), {_random_ctes('every_text', 'k0')}
--FINAL SELECT k AS doc_id, literal, h AS entropy FROM random_lits""")
oracle("rule_matches", "unit_key b, rule s, hits b", "WITH " + UNITS + ", m AS (" + " UNION ALL ".join(
    f"SELECT unit_key, '{api}' AS rule, len(regexp_extract_all(code, {q(B + 'b' + RE2(pat))})) AS hits FROM units"
    for api, pat in fixed.INVALID_CALLS.items()) + ") --FINAL SELECT * FROM m WHERE hits > 0")
oracle("severity_matrix", "unit_key b, kind s, score b, severity s, category s", f"""WITH {UNIT_SCORES}, r AS (SELECT k AS unit_key, score * 2 AS score,
CASE k % 4 WHEN 0 THEN 'secret' WHEN 1 THEN 'known-vulnerability' WHEN 2 THEN 'insecure-pattern' ELSE 'code-quality' END AS kind,
CASE k % 7 WHEN 0 THEN 'injection' WHEN 1 THEN 'credential-exposure' WHEN 2 THEN 'unsafe-dynamic-exec' WHEN 3 THEN 'weak-crypto'
 WHEN 4 THEN 'data-exposure' WHEN 5 THEN 'insecure-config' ELSE 'code-quality' END AS category FROM scored)
--FINAL SELECT *, CASE kind WHEN 'secret' THEN CASE WHEN score >= 65 THEN 'CRITICAL' ELSE 'HIGH' END
 WHEN 'known-vulnerability' THEN CASE WHEN score >= 65 THEN 'HIGH' ELSE 'MEDIUM' END
 ELSE CASE WHEN score >= 65 THEN 'MEDIUM' ELSE 'LOW' END END AS severity FROM r""")
oracle("suppressed_findings", "l_orderkey b, l_linenumber b, l_partkey b, id s, severity s",
       f"WITH {FINDINGS} --FINAL SELECT l_orderkey, l_linenumber, l_partkey, id, severity FROM findings WHERE l_partkey % 10 <> 3 OR l_linenumber NOT BETWEEN 1 AND 7")
oracle("import_audit", "file s, module s, export s, rule_id s, id s", """WITH src AS (SELECT 'p' || p_partkey || '.ts' AS path,
 'NATION_' || (p_partkey % 31) AS m1, 'f' || (p_partkey % 9) AS f1, 'NATION_' || p_size AS m2 FROM part),
used AS (SELECT path, m1 AS module, f1 AS export FROM src UNION ALL SELECT path, m1, 'g' FROM src UNION ALL SELECT path, m2, NULL FROM src),
bad AS (SELECT DISTINCT path, module, NULL AS export, 'hallucination.unknown-package' AS rule_id, module AS key FROM used
  WHERE module NOT IN (SELECT n_name FROM nation)
 UNION ALL SELECT DISTINCT path, module, export, 'hallucination.unknown-export', module || '.' || export FROM used
  JOIN nation ON n_name = module WHERE export IS NOT NULL AND export <> 'g' AND export <> 'f' || (n_nationkey % 9))
--FINAL SELECT path AS file, module, export, rule_id, substring(sha1('import:' || path || ':' || key), 1, 10) AS id FROM bad""")
# What each form binds is known from the file: (module, kind, export, local name); a, b and n are of the row.
_BOUND = """SELECT 'q' || p_partkey || '.ts' AS path, unnest([
 {'module': a, 'kind': 'default', 'export': 'default', 'local': 'top'}, {'module': a, 'kind': 'named', 'export': 'f' || n, 'local': 'one'},
 {'module': a, 'kind': 'named', 'export': 'g', 'local': 'g'}, {'module': b, 'kind': 'namespace', 'export': NULL, 'local': 'space'},
 {'module': b, 'kind': 'named', 'export': 'Shape', 'local': 'Shape'}, {'module': a, 'kind': 'module', 'export': NULL, 'local': NULL},
 {'module': a, 'kind': 'named', 'export': 'g', 'local': 'two'}, {'module': a, 'kind': 'named', 'export': 'f' || n, 'local': 'f' || n},
 {'module': b, 'kind': 'namespace', 'export': NULL, 'local': 'whole'}, {'module': a, 'kind': 'namespace', 'export': NULL, 'local': 'later'},
 {'module': b, 'kind': 'named', 'export': 'g', 'local': NULL}, {'module': a, 'kind': 'module', 'export': NULL, 'local': NULL}]) AS x
 FROM (SELECT *, 'NATION_' || (p_partkey % 31) AS a, 'NATION_' || p_size AS b, p_partkey % 9 AS n FROM part)"""
oracle("import_bindings", "path s, module s, kind s, export s, local s",
       f"WITH bound AS ({_BOUND}) --FINAL SELECT path, x.module AS module, x.kind AS kind, x.export AS export, x.local AS local FROM bound")
oracle("unknown_bound_calls", "path s, module s, export s, local s", """WITH calls AS (SELECT 'q' || p_partkey || '.ts' AS path, unnest([
 {'module': a, 'export': 'f' || n, 'local': 'top'}, {'module': b, 'export': 'g', 'local': 'space'}, {'module': b, 'export': 'f' || n, 'local': 'whole'},
 {'module': a, 'export': 'h', 'local': 'later'}]) AS x
 FROM (SELECT *, 'NATION_' || (p_partkey % 31) AS a, 'NATION_' || p_size AS b, p_partkey % 9 AS n FROM part))
--FINAL SELECT path, x.module AS module, x.export AS export, x.local AS local FROM calls JOIN nation ON n_name = x.module
 WHERE x.export <> 'g' AND x.export <> 'f' || (n_nationkey % 9)""")
_MEMBER = B + "b[A-Za-z_$][A-Za-z0-9_$]*" + B + ".[A-Za-z_$][A-Za-z0-9_$]*" + B + "s*" + B + "("
oracle("unknown_member_calls", "path s, module s, export s", f"""WITH {UNITS}, cat AS (SELECT
 CASE n_nationkey % 3 WHEN 0 THEN 'axios' WHEN 1 THEN 'fs' ELSE 'res' END AS module,
 CASE n_nationkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'readFile' WHEN 2 THEN 'status' ELSE 'post' END AS export FROM nation),
calls AS (SELECT path, unnest(regexp_extract_all(code, {q(_MEMBER)})) AS c FROM units),
parts AS (SELECT DISTINCT path, split_part(c, '.', 1) AS module, rtrim(rtrim(split_part(c, '.', 2), '('), ' ') AS export FROM calls)
--FINAL SELECT * FROM parts p WHERE module IN (SELECT module FROM cat)
 AND NOT EXISTS (SELECT 1 FROM cat WHERE cat.module = p.module AND cat.export = p.export)""")

# --- report ------------------------------------------------------------------------------------------

_LOCAL = f"""{LOCATED}, calls AS ({_CALLS}), {_random_ctes('located', 'unit_key', _AT)},
hits AS ({_secret_rows('located', 'unit_key', _AT)} UNION ALL SELECT k{_AT}, 'high-entropy-literal', literal FROM random_lits),
local AS (SELECT path AS file, CASE WHEN score >= 65 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM hits
 UNION ALL SELECT path, CASE WHEN score >= 65 THEN 'HIGH' ELSE 'MEDIUM' END FROM calls WHERE flagged)"""


def _summary(all_findings: str) -> str:
    return f"""every AS ({all_findings}),
f AS (SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) AS findings FROM every),
u AS (SELECT count(*) AS total_units, count(*) FILTER (flagged) AS flagged_units, sum(loc) AS total_loc, sum(score) AS points_sum,
  count(*) FILTER (band = 'LOW') AS band_low, count(*) FILTER (band = 'UNCERTAIN') AS band_uncertain,
  count(*) FILTER (band = 'HIGH') AS band_high FROM located),
p AS (SELECT count(DISTINCT path) AS files_scanned FROM (SELECT path FROM located UNION ALL SELECT file FROM every)),
s AS (SELECT *, 0 AS skipped_files, critical + high > 0 AS blocked, {rnd('points_sum / greatest(1, total_units)')} AS ai_score,
  flagged_units / greatest(1, total_units) AS flag_ratio, {rnd('flagged_units / greatest(1, total_units) * 100')} AS ai_percentage,
  floor(critical / greatest(1, total_loc) * 1000 * 10 + 0.5) / 10 AS critical_per_1k_loc,
  floor(findings / greatest(1, total_loc) * 1000 * 10 + 0.5) / 10 AS findings_per_1k_loc, 9 AS threshold FROM f, u, p),
summary AS (SELECT *, CASE WHEN ai_score = threshold THEN 'at threshold' WHEN ai_score < threshold THEN 'below threshold'
  ELSE 'above threshold' END AS score_relation,
  CASE WHEN blocked THEN 'blocked (security findings matched block policy)' ELSE 'pass' END AS gate_reason FROM s)"""


_SUMMARY_SPEC = (
    "files_scanned b, skipped_files b, total_units b, flagged_units b, total_loc b, critical b, high b, medium b, low b, findings b, "
    "blocked o, ai_score b, flag_ratio d, ai_percentage b, critical_per_1k_loc d, findings_per_1k_loc d, band_low b, "
    "band_uncertain b, band_high b, threshold b, score_relation s, gate_reason s"
)
oracle("report_summary", _SUMMARY_SPEC, f"WITH {_LOCAL}, {_summary('SELECT * FROM local')} --FINAL SELECT * FROM summary")
oracle("report_summary_external", _SUMMARY_SPEC,
       f"WITH {_LOCAL}, {FINDINGS}, {_summary('SELECT * FROM local UNION ALL SELECT file, severity FROM findings')} --FINAL SELECT * FROM summary")
_CONTRIBUTIONS = "contrib AS (" + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{n}' AS signal, sum({SHORT[n]}) AS score, count(*) * {w} AS max_weight FROM scored"
    for i, (n, w) in enumerate(fixed.SIGNAL_WEIGHTS.items())) + ")"
oracle("weighted_contributions", "signal s, contribution b, score b, max_weight b", f"""WITH {UNIT_SCORES}, {_CONTRIBUTIONS}
--FINAL SELECT signal, {rnd('score / (SELECT sum(score) FROM contrib) * 100')} AS contribution, score, max_weight FROM contrib
ORDER BY score DESC, ord LIMIT 8""")
oracle("severity_share", "place b, severity s, findings b, width b", f"""WITH {FINDINGS}, c AS (SELECT severity, count(*) AS n FROM findings GROUP BY severity)
--FINAL SELECT CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS place, severity, n AS findings,
greatest(2, {rnd('n / (SELECT sum(n) FROM c) * 16')}) AS width FROM c""")
oracle("critical_per_file", "file s, critical b, findings b",
       f"WITH {FINDINGS} --FINAL SELECT file, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) AS findings FROM findings GROUP BY file")
oracle("first_findings", "file s, line b, id s, l_orderkey b",
       f"WITH {FINDINGS} --FINAL SELECT file, line, id, l_orderkey FROM findings ORDER BY file, line, id, l_orderkey LIMIT 50")

# --- attribution -----------------------------------------------------------------------------------------

_TURNS = """turns AS (SELECT 'conv' || conv_id AS path, turn AS ordinal, turn * 8 + 1 AS start_line,
 turn * 8 + 20 + length(text) % 30 AS end_line, length(text) % 101 AS score FROM conversations)"""
_PLACES = """places AS (SELECT l_orderkey, l_linenumber, l_partkey, 'conv' || (l_orderkey % 120) AS file,
 cast(l_quantity * 2 AS bigint) AS line FROM lineitem)"""
oracle("attribute_findings", "l_orderkey b, l_linenumber b, l_partkey b, file s, line b, unit_ordinal b, ai_score b", f"""WITH {_TURNS}, {_PLACES},
spots AS (SELECT DISTINCT file, line FROM places),
owner AS (SELECT file, line, min(ordinal) AS unit_ordinal, arg_min(score, ordinal) AS unit_score FROM spots JOIN turns
  ON turns.path = file AND line BETWEEN start_line AND end_line GROUP BY file, line)
--FINAL SELECT p.*, unit_ordinal, coalesce(unit_score, 9) AS ai_score FROM places p LEFT JOIN owner USING (file, line)""")
oracle("files_seen", "path s", f"WITH {_TURNS}, {_PLACES} --FINAL SELECT path FROM turns UNION SELECT file FROM places")
oracle("changed_units", "path s, ordinal b, start_line b, end_line b", f"""WITH {_TURNS},
changes AS (SELECT 'conv' || (l_orderkey % 120) AS path, cast(l_quantity * 3 AS bigint) AS a, cast(l_quantity * 3 + l_linenumber - 3 AS bigint) AS b
  FROM lineitem WHERE l_returnflag = 'R')
--FINAL SELECT path, ordinal, start_line, end_line FROM turns t WHERE EXISTS (SELECT 1 FROM changes c WHERE c.path = t.path AND a <= b
 AND t.start_line <= c.b AND t.end_line >= c.a)""")
oracle("changed_files", "path s, ordinal b", f"""WITH {_TURNS} --FINAL SELECT path, ordinal FROM turns
WHERE path IN (SELECT 'conv' || (l_partkey % 120) FROM lineitem WHERE l_quantity = 50)""")

# --- delta ---------------------------------------------------------------------------------------------------

oracle("delta_new", "l_orderkey b, l_linenumber b, id s, severity s",
       f"WITH {FINDINGS} --FINAL SELECT l_orderkey, l_linenumber, id, severity FROM findings WHERE current AND id NOT IN (SELECT id FROM findings WHERE NOT current)")
oracle("delta_resolved", "l_orderkey b, l_linenumber b, id s, severity s",
       f"WITH {FINDINGS} --FINAL SELECT l_orderkey, l_linenumber, id, severity FROM findings WHERE NOT current AND id NOT IN (SELECT id FROM findings WHERE current)")
_SEV = [s.lower() for s in fixed.SEVERITIES]
_DELTA_SPEC = (
    "risk_current b, risk_previous b, findings_current b, findings_previous b, new_findings b, resolved_findings b, "
    + ", ".join(f"new_{s} b, resolved_{s} b" for s in _SEV)
    + ", baseline o, risk_change b, findings_change b, regression_alert o"
)


def _delta(now: str, old: str, baseline: str) -> str:
    sides = ", ".join(
        f"(SELECT count(*) FROM fresh WHERE severity = '{s}') AS new_{s.lower()}, "
        f"(SELECT count(*) FROM gone WHERE severity = '{s}') AS resolved_{s.lower()}" for s in fixed.SEVERITIES
    )
    return f"""now_f AS ({now}), old_f AS ({old}),
fresh AS (SELECT * FROM now_f WHERE NOT EXISTS (SELECT 1 FROM old_f WHERE old_f.id = now_f.id)),
gone AS (SELECT * FROM old_f WHERE NOT EXISTS (SELECT 1 FROM now_f WHERE old_f.id = now_f.id)),
t AS (SELECT (SELECT coalesce(sum({RISK}), 0) FROM now_f) AS risk_current, (SELECT coalesce(sum({RISK}), 0) FROM old_f) AS risk_previous,
 (SELECT count(*) FROM now_f) AS findings_current, (SELECT count(*) FROM old_f) AS findings_previous,
 (SELECT count(*) FROM fresh) AS new_findings, (SELECT count(*) FROM gone) AS resolved_findings, {sides}),
delta AS (SELECT *, {baseline} AS baseline, risk_current - risk_previous AS risk_change, findings_current - findings_previous AS findings_change,
 NOT {baseline} AND (risk_current - risk_previous >= 5 OR new_critical > 0) AS regression_alert FROM t)"""


_NOW, _OLD = "SELECT id, severity FROM findings WHERE current", "SELECT id, severity FROM findings WHERE NOT current"
oracle("delta_summary", _DELTA_SPEC, f"WITH {FINDINGS}, {_delta(_NOW, _OLD, 'false')} --FINAL SELECT * FROM delta")
oracle("delta_baseline", _DELTA_SPEC, f"WITH {FINDINGS}, {_delta(_NOW, _OLD + ' AND false', 'true')} --FINAL SELECT * FROM delta")
_FOLDERS = f"""placed AS (SELECT *, {FOLDER} AS folder, {RISK} AS risk FROM findings),
a AS (SELECT folder, sum(risk) AS risk FROM placed WHERE current GROUP BY folder),
b AS (SELECT folder, sum(risk) AS risk FROM placed WHERE NOT current GROUP BY folder),
folders AS (SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.risk, 0) AS current_risk, coalesce(b.risk, 0) AS previous_risk,
 coalesce(a.risk, 0) - coalesce(b.risk, 0) AS change, a.folder IS NOT NULL AS present FROM a FULL JOIN b ON a.folder = b.folder)"""
_FOLDER_SPEC = "folder s, current_risk b, previous_risk b, change b"
oracle("folder_changes", _FOLDER_SPEC, f"WITH {FINDINGS}, {_FOLDERS} --FINAL SELECT * FROM folders")
oracle("folder_movement", _FOLDER_SPEC,
       f"WITH {FINDINGS}, {_FOLDERS} --FINAL SELECT * FROM folders WHERE change <> 0 ORDER BY abs(change) DESC, present DESC, folder LIMIT 3")
_SERIES_SUMS = ", ".join(
    f"count(*) FILTER (is_now AND fresh AND severity = '{s}') AS new_{s.lower()}, "
    f"count(*) FILTER (NOT is_now AND gone AND severity = '{s}') AS resolved_{s.lower()}" for s in fixed.SEVERITIES
)
oracle("delta_series", "target_key s, scan_ts s, " + _DELTA_SPEC, f"""WITH e AS (SELECT cast(user_id AS varchar) AS target_key, cast(ts AS date) AS scan_ts, event_type,
 substring(sha1(event_type || ':' || (cast(json_extract_string(props, '$.k') AS int) % 5)), 1, 10) AS id,
 CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events),
days AS (SELECT DISTINCT target_key, scan_ts FROM e),
chain AS (SELECT *, lag(scan_ts) OVER (PARTITION BY target_key ORDER BY scan_ts) AS prev_ts FROM days),
found AS (SELECT * FROM e WHERE event_type <> 'view'),
now_rows AS (SELECT c.target_key, c.scan_ts, f.id, f.severity, {RISK} AS risk, true AS is_now,
  NOT EXISTS (SELECT 1 FROM found o WHERE o.target_key = c.target_key AND o.scan_ts = c.prev_ts AND o.id = f.id) AS fresh, false AS gone
  FROM chain c JOIN found f ON f.target_key = c.target_key AND f.scan_ts = c.scan_ts),
old_rows AS (SELECT c.target_key, c.scan_ts, f.id, f.severity, {RISK} AS risk, false AS is_now, false AS fresh,
  NOT EXISTS (SELECT 1 FROM found o WHERE o.target_key = c.target_key AND o.scan_ts = c.scan_ts AND o.id = f.id) AS gone
  FROM chain c JOIN found f ON f.target_key = c.target_key AND f.scan_ts = c.prev_ts),
rows_ AS (SELECT * FROM now_rows UNION ALL SELECT * FROM old_rows),
agg AS (SELECT target_key, scan_ts, sum(risk) FILTER (is_now) AS rc, sum(risk) FILTER (NOT is_now) AS rp,
  count(*) FILTER (is_now) AS fc, count(*) FILTER (NOT is_now) AS fp, count(*) FILTER (is_now AND fresh) AS nf,
  count(*) FILTER (NOT is_now AND gone) AS rf, {_SERIES_SUMS} FROM rows_ GROUP BY target_key, scan_ts),
final AS (SELECT c.target_key, strftime(c.scan_ts, '%Y-%m-%d') AS scan_ts, coalesce(rc, 0) AS risk_current, coalesce(rp, 0) AS risk_previous,
  coalesce(fc, 0) AS findings_current, coalesce(fp, 0) AS findings_previous, coalesce(nf, 0) AS new_findings, coalesce(rf, 0) AS resolved_findings,
  {', '.join(f'coalesce(new_{s}, 0) AS new_{s}, coalesce(resolved_{s}, 0) AS resolved_{s}' for s in _SEV)}, prev_ts IS NULL AS baseline
  FROM chain c LEFT JOIN agg ON agg.target_key = c.target_key AND agg.scan_ts = c.scan_ts)
--FINAL SELECT *, risk_current - risk_previous AS risk_change, findings_current - findings_previous AS findings_change,
 NOT baseline AND (risk_current - risk_previous >= 5 OR new_critical > 0) AS regression_alert FROM final""")
_ROWS = []
for _i, (_section, _label, _value) in enumerate([
    ("metrics", "files", "files_scanned"), ("metrics", "units", "total_units"), ("metrics", "ai-flagged units", "flagged_units"),
    ("metrics", "AI score", "ai_score || '/100'"), ("metrics", "AI%", "ai_percentage || '%'"),
    ("metrics", "risk", "regexp_replace(printf('%.1f', findings_per_1k_loc), '[.]0$', '') || '/1k LOC'"),
    ("metrics", "gate", "CASE WHEN blocked THEN 'blocked' ELSE 'pass' END"), ("metrics", "gate reason", "gate_reason || ', ' || (SELECT CASE WHEN new_high + new_critical > 0 THEN '+' ELSE '' END || (new_high + new_critical) FROM delta) || ' high-risk vs last run'"),
    ("ai-origin", "score", "ai_score || '/100'"), ("ai-origin", "flagged units", "flagged_units"),
    ("ai-origin", "ratio", "ai_percentage || '%'"), ("ai-origin", "threshold", "threshold"),
    *[("security", s, s) for s in _SEV], *[("bands", b, f"band_{b.lower()}") for b in fixed.BANDS],
]):
    _ROWS.append(f"SELECT {_i} AS place, '{_section}' AS section, '{_label}' AS label, cast({_value} AS varchar) AS value FROM summary")
_SIGNED = lambda x: f"CASE WHEN {x} > 0 THEN '+' || cast({x} AS varchar) ELSE cast({x} AS varchar) END"
_ROWS.append(
    f"SELECT 99 + p, 'top signals', signal, {rnd('score / (SELECT sum(score) FROM contrib) * 100')} || '%' FROM "
    f"(SELECT *, row_number() OVER (ORDER BY score DESC, list_position({list(fixed.SIGNAL_WEIGHTS)}, signal)) AS p FROM contrib) WHERE p <= 4"
)
for _i, (_label, _value) in enumerate([
    ("new", "cast(new_findings AS varchar)"), ("resolved", "cast(resolved_findings AS varchar)"), ("risk delta", _SIGNED("risk_change")),
    ("alert", "CASE WHEN regression_alert THEN 'regression' ELSE 'stable' END"),
]):
    _ROWS.append(f"SELECT {200 + _i}, 'delta', '{_label}', {_value} FROM delta")
oracle("report_rows", "place b, section s, label s, value s",
       f"WITH {_LOCAL}, {FINDINGS}, {_summary('SELECT * FROM local')}, {_CONTRIBUTIONS}, {_delta(_NOW, _OLD, 'false')} --FINAL "
       + " UNION ALL ".join(_ROWS))

# --- calibration -------------------------------------------------------------------------------------------------

_PARTS = f"""lines_ AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'ai' ELSE 'human' END AS label, unnest(string_split(text, chr(10))) AS code
  FROM documents JOIN labels USING (doc_id)),
parts AS (SELECT *, '' AS prefix, row_number() OVER () AS part_no FROM lines_ WHERE regexp_matches(code, {q(f'[^{WS}]')})),
{figures('parts', 'part_no')}, {scores()},
samples AS (SELECT doc_id, label, {rnd('sum(score) / count(*)')} AS score, count(*) AS units FROM scored JOIN parts ON scored.k = parts.part_no GROUP BY doc_id, label)"""
oracle("calibration_samples", "doc_id b, label s, score b, units b", f"WITH {_PARTS} --FINAL SELECT * FROM samples")
oracle("calibration_counts", "files b, human_files b, ai_files b",
       f"WITH {_PARTS} --FINAL SELECT count(*) AS files, count(*) FILTER (label = 'human') AS human_files, count(*) FILTER (label = 'ai') AS ai_files FROM samples")
_SWEEP = f"""{_PARTS}, c AS (SELECT t.threshold, count(*) FILTER (score >= t.threshold AND label = 'ai') AS tp,
 count(*) FILTER (score >= t.threshold AND label <> 'ai') AS fp, count(*) FILTER (score < t.threshold AND label <> 'ai') AS tn,
 count(*) FILTER (score < t.threshold AND label = 'ai') AS fn FROM samples, (SELECT unnest(range(101)) AS threshold) t GROUP BY t.threshold),
m AS (SELECT *, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall, (tp + tn) / greatest(1, tp + fp + tn + fn) AS accuracy FROM c),
sweep AS (SELECT *, 2 * precision * recall / greatest(1e-9, precision + recall) AS f1 FROM m)"""
_SWEEP_SPEC = "threshold b, tp b, fp b, tn b, fn b, precision d, recall d, f1 d, accuracy d"
oracle("calibration_sweep", _SWEEP_SPEC, f"WITH {_SWEEP} --FINAL SELECT * FROM sweep")
oracle("calibration_best", _SWEEP_SPEC, f"""WITH {_SWEEP} --FINAL SELECT * FROM sweep
ORDER BY (precision >= 0.9 AND recall >= 0.5) DESC, f1 DESC, precision DESC, recall DESC, threshold LIMIT 1""")
oracle("detection_quality",
       "tp b, fp b, tn b, fn b, precision d, recall d, f1 d, accuracy d, false_positive_rate d, false_discovery_rate d",
       f"WITH {_SWEEP} --FINAL SELECT *, fp / greatest(1, fp + tn) AS false_positive_rate, 1 - precision AS false_discovery_rate FROM sweep WHERE threshold = 20")

# --- normalisers -----------------------------------------------------------------------------------------------------

_RAW_SPEC = "scan b, id s, rule_id s, file s, line b, column s, code s, type s, message s, category s, severity s".replace("column s", "column b")


def _json_rows(table: str, key: str, template: str, path: str) -> str:
    return (
        f"docs_ AS (SELECT {key} AS scan, {raw(template)} AS raw FROM {table}), "
        f"valid AS (SELECT scan, cast(raw AS json) AS j FROM docs_ WHERE json_valid(raw)), "
        f"items AS (SELECT scan, unnest(cast(json_extract(j, '{path}') AS json[])) AS r FROM valid WHERE json_type(j, '{path}') = 'ARRAY')"
    )


def _js(field: str, of: str = "r") -> str:
    return f"json_extract_string({of}, '$.{field}')"


def _or(x: str, default: str) -> str:
    return f"coalesce(nullif({x}, ''), {default})"


def _path(x: str) -> str:
    """Joined to the root; the only dotted inputs are the fixed ones."""
    return f"""CASE {x} WHEN '' THEN '/work/repo' WHEN '../up.js' THEN '/work/up.js'
 ELSE CASE WHEN starts_with({x}, '/abs/./q/../') THEN '/abs/' || substring({x}, 13) WHEN starts_with({x}, '/') THEN {x} ELSE '/work/repo/' || {x} END END"""


_SG_ITEMS = _json_rows("part", "p_partkey", rawjson.SEMGREP, "$.results")
oracle("norm_semgrep", _RAW_SPEC, f"""WITH {_SG_ITEMS},
x AS (SELECT scan, {_path(_js('path'))} AS file, coalesce(cast({_js('start.line')} AS int), 1) AS line, coalesce(cast({_js('start.col')} AS int), 1) AS col,
 {_or(_js('check_id'), "'semgrep.unknown-rule'")} AS rule, upper(coalesce({_js('extra.severity')}, '')) AS sev, r FROM items)
--FINAL SELECT scan, substring(sha1('semgrep:' || file || ':' || line || ':' || col || ':' || rule), 1, 10) AS id, rule AS rule_id, file, line, col AS "column",
 coalesce(trim({_js('extra.lines')}), '') AS code,
 'Semgrep ' || translate(list_filter(string_split(rule, '.'), lambda p: p <> '')[-1], '-_', '  ') AS type,
 {_or('trim(' + _js('extra.message') + ')', "'Semgrep finding'")} AS message,
 {_or(_js('extra.metadata.category'), "'code-security'")} AS category,
 CASE WHEN contains(sev, 'ERROR') OR contains(sev, 'CRITICAL') THEN 'CRITICAL' WHEN contains(sev, 'WARNING') OR contains(sev, 'HIGH') THEN 'HIGH'
 WHEN contains(sev, 'INFO') OR contains(sev, 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM x""")
_ES = f"""{_json_rows('part', 'p_partkey', rawjson.ESLINT, '$')},
es AS (SELECT scan, {_js('filePath')} AS file, unnest(cast(json_extract(r, '$.messages') AS json[])) AS m FROM items),
x AS (SELECT scan, file, {_js('ruleId', 'm')} AS rule, cast({_js('line', 'm')} AS int) AS line, cast({_js('column', 'm')} AS int) AS col,
 cast({_js('severity', 'm')} AS int) AS level, {_js('message', 'm')} AS message FROM es WHERE {_js('ruleId', 'm')} IS NOT NULL),
y AS (SELECT *, substring(sha1('eslint:' || file || ':' || line || ':' || col || ':' || rule), 1, 10) AS id FROM x)"""
oracle("norm_eslint", _RAW_SPEC, f"""WITH {_ES}
--FINAL SELECT scan, id, rule AS rule_id, file, line, col AS "column", '' AS code, 'ESLint ' || translate(string_split(rule, '/')[-1], '-_', '  ') AS type, message,
 CASE WHEN starts_with(rule, 'security/') THEN 'code-security' WHEN contains(rule, 'regex') THEN 'regex-security'
 WHEN contains(rule, 'eval') OR contains(rule, 'buffer') THEN 'unsafe-code-execution' ELSE 'code-quality' END AS category,
 CASE level WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM y""")
oracle("eslint_selected", "scan b, id s, rule_id s",
       f"WITH {_ES} --FINAL SELECT scan, id, rule AS rule_id FROM y WHERE rule = 'security/detect-object-injection'")
_NPM = lambda template: f"""docs_ AS (SELECT p_partkey AS scan, cast({raw(template)} AS json) AS j FROM part),
packs AS (SELECT scan, unnest(json_keys(j, '$.vulnerabilities')) AS pkg, j FROM docs_),
v AS (SELECT scan, pkg, json_extract(j, '$.vulnerabilities."' || pkg || '"') AS r FROM packs)"""  # noqa: E731
_NPM_SEV = lambda x: f"CASE lower(coalesce({x}, 'low')) WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'moderate' THEN 'MEDIUM' ELSE 'LOW' END"
_NPM_OUT = lambda src: f"""SELECT scan, substring(sha1('npm-audit:' || key || ':' || affected), 1, 10) AS id, 'npm-audit:' || key AS rule_id,
 '/work/repo/package.json' AS file, 1 AS line, 1 AS "column", '"' || affected || '"' AS code, 'Dependency Vulnerability' AS type, message,
 'supply-chain-security' AS category, severity FROM {src}"""  # noqa: E731
_LEGACY = f"""{_NPM(rawjson.NPM_LEGACY)},
lp AS (SELECT *, list_distinct(flatten(list_transform(cast(json_extract(r, '$.findings') AS json[]), lambda f: coalesce(cast(json_extract(f, '$.paths') AS varchar[]), [])))) AS ps FROM v),
lx AS (SELECT scan, coalesce({_js('id')}, pkg) AS key, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [pkg] END) AS affected,
 {_or('trim(' + _js('title') + ')', "'Vulnerability in ' || pkg")} AS title, {_NPM_SEV(_js('severity'))} AS severity FROM lp),
legacy AS (SELECT *, title || ' (affected: ' || affected || ')' AS message FROM lx)"""
oracle("norm_npm_legacy", _RAW_SPEC, f"WITH {_LEGACY} --FINAL {_NPM_OUT('legacy')}")
oracle("npm_threshold", "scan b, id s, threshold s", f"""WITH {_LEGACY}, o AS ({_NPM_OUT('legacy')})
--FINAL SELECT scan, id, 'moderate' AS threshold FROM o WHERE severity <> 'LOW' UNION ALL SELECT scan, id, 'unknown' FROM o""")
oracle("norm_npm_modern", _RAW_SPEC, f"""WITH {_NPM(rawjson.NPM_MODERN)},
n AS (SELECT *, coalesce(cast(json_extract(r, '$.nodes') AS varchar[])[1], pkg) AS affected,
 list_filter(cast(json_extract(r, '$.via') AS json[]), lambda e: json_type(e) = 'OBJECT') AS objs FROM v),
o AS (SELECT *, unnest(objs) AS e, generate_subscripts(objs, 1) - 1 AS i FROM n),
modern AS (SELECT scan, affected, coalesce({_js('source', 'e')}, {_js('name', 'e')}, pkg || '-' || i) AS key,
 {_or('trim(' + _js('title', 'e') + ')', "'Vulnerability in ' || coalesce(" + _js('name', 'e') + ", pkg)")} || ' (affected: ' || pkg ||
 coalesce(' ' || nullif(trim({_js('range', 'e')}), ''), '') || ')' AS message, {_NPM_SEV(f"coalesce({_js('severity', 'e')}, {_js('severity')})")} AS severity FROM o
 UNION ALL SELECT scan, affected, {_or('trim(' + _js('name') + ')', 'pkg')}, 'Vulnerability in ' || pkg, {_NPM_SEV(_js('severity'))} FROM n WHERE len(objs) = 0)
--FINAL {_NPM_OUT('modern')}""")


def _first_rule(x: str, table, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({x}, '{n}')" for n in needles) + f" THEN '{c}'" for c, needles in table)
    return f"CASE {whens} ELSE {default} END"


oracle("norm_nodejsscan", _RAW_SPEC, f"""WITH {_json_rows('supplier', 's_suppkey', rawjson.NODEJSSCAN, '$.results')},
x AS (SELECT scan, {_path(_js('file'))} AS file, coalesce(nullif(cast({_js('line')} AS int), 0), 1) AS line, {_or(_js('issue'), "'Node.js security issue'")} AS issue,
 lower(coalesce({_js('severity')}, '')) AS sev, coalesce({_js('code')}, '') AS code FROM items)
--FINAL SELECT scan, substring(sha1('nodejsscan:' || file || ':' || line || ':' || issue), 1, 10) AS id,
 'nodejsscan:' || lower(regexp_replace(issue, '{B}s+', '-', 'g')) AS rule_id, file, line, 1 AS "column", code, 'Node.js Security Issue' AS type, issue AS message,
 {_first_rule('lower(issue)', fixed.NODEJSSCAN_CATEGORIES, "'nodejs-security'")} AS category,
 CASE WHEN contains(sev, 'critical') OR contains(sev, 'high') THEN 'HIGH' WHEN contains(sev, 'medium') OR contains(sev, 'warning') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM x""")
_BR_SLUG = f"lower(regexp_replace(cat, '{B}s+', '-', 'g'))"
oracle("norm_bearer", _RAW_SPEC, f"""WITH {_json_rows('supplier', 's_suppkey', rawjson.BEARER, '$.findings')},
x AS (SELECT scan, {_path(_js('file.path'))} AS file, coalesce(nullif(cast({_js('file.line')} AS int), 0), 1) AS line,
 coalesce(nullif(cast({_js('file.column')} AS int), 0), 1) AS col, coalesce(cast(json_extract(r, '$.data_types') AS varchar[]), []) AS kinds,
 {_js('category')} AS cat, {_js('title')} AS title, {_js('description')} AS descr, lower(coalesce({_js('severity')}, '')) AS sev,
 coalesce({_js('snippet.code')}, '') AS code FROM items WHERE coalesce({_js('file.path')}, '') <> '')
--FINAL SELECT scan, substring(sha1('bearer:' || file || ':' || line || ':' || title), 1, 10) AS id, 'bearer:' || {_BR_SLUG} AS rule_id, file, line, col AS "column", code,
 'Bearer ' || translate(cat, '-_', '  ') || CASE WHEN len(kinds) > 0 THEN ' (' || kinds[1] || ')' ELSE '' END AS type,
 {_or('descr', _or('title', "'Bearer finding'"))} || CASE WHEN len(kinds) > 0 THEN ' (data types: ' || array_to_string(kinds, ', ') || ')' ELSE '' END AS message,
 CASE WHEN len(kinds) > 0 THEN 'data-privacy' ELSE {_first_rule('lower(cat)', fixed.BEARER_CATEGORIES, _BR_SLUG)} END AS category,
 CASE sev WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM x""")

# --- paths and URLs ------------------------------------------------------------------------------------------------------

_EXT = "regexp_extract(path, '[^/]([.][^./]*)$', 1)"
_in = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
_DIRS = "string_split(path, '/')[1:-2]"
_PATHS = (
    f"paths_ AS (SELECT p_partkey, {qs.PATH_SQL.format(s='varchar')} AS path, "
    "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey * 1000 END AS length_ FROM part), "
    f"st AS (SELECT *, CASE WHEN length_ IS NULL THEN 'missing' WHEN length_ > 1048576 THEN 'skipped' ELSE 'scanned' END AS status, "
    f"regexp_matches(path, '[.](js|jsx|ts|tsx)$') AS cli_source, "
    f"list_has_any({_DIRS}, [{', '.join(q(d) for d in fixed.CLI_IGNORED_DIRS)}]) AS cli_ignored FROM paths_)"
)
oracle("path_filter", "p_partkey b, path s, cli_source o, web_source o, calibration_source o, cli_ignored o, web_ignored o, dotted o, excluded o, status s, folder s",
       f"""WITH {_PATHS} --FINAL SELECT p_partkey, path, cli_source, {_EXT} IN {_in(fixed.WEB_EXTENSIONS)} AS web_source,
 {_EXT} IN {_in(fixed.CALIBRATION_EXTENSIONS)} AS calibration_source, cli_ignored,
 list_has_any(string_split(path, '/'), [{', '.join(q(d) for d in fixed.WEB_IGNORED_DIRS)}]) AS web_ignored,
 regexp_matches(path, '(^|/)[.]') AS dotted,
 list_has_any(string_split(path, '/'), ['test', 'src']) OR contains('/' || path, '/gen/api/') AS excluded, status,
 CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '<root>' END AS folder FROM st""")
oracle("file_status_counts", "status s, files b", f"""WITH {_PATHS} --FINAL SELECT status, count(*) AS files FROM st WHERE cli_source AND NOT cli_ignored
 AND NOT list_has_any(string_split(path, '/'), ['node_modules','dist','build','.git','coverage','test','tests','__tests__']) GROUP BY status""")
oracle("url_audit", "page_id b, error s, canonical s, host s", f"""WITH u AS (SELECT page_id, trim(url) AS url,
 lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
--FINAL SELECT page_id, CASE WHEN url = '' THEN '{fixed.URL_MISSING}' WHEN host = '' THEN '{fixed.URL_INVALID}' WHEN NOT starts_with(url, 'https:') THEN '{fixed.URL_NOT_HTTPS}'
 WHEN host = 'localhost' OR ends_with(host, '.local') THEN '{fixed.URL_PRIVATE}' END AS error, host,
 CASE WHEN starts_with(url, 'https:') THEN CASE WHEN regexp_matches(split_part(url, '#', 1), '^https://[^/]*$')
   THEN split_part(url, '#', 1) || '/' ELSE split_part(url, '#', 1) END END AS canonical FROM u""")
_36 = lambda x: "right(" + " || ".join(
    f"substring('0123456789abcdefghijklmnopqrstuvwxyz', cast(({x} // {36 ** i}) % 36 AS int) + 1, 1)" for i in range(7, -1, -1)) + ", 6)"
oracle("repo_name", "page_id b, name s, scan_id s", f"""WITH n AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(trim(url), '/+$', ''), '/([^/]+)$', 1), '(?i)[.]git$', ''), ''), 'repository') AS name,
 1700000000000 + page_id * 7919 AS ms FROM pages)
--FINAL SELECT page_id, name, 'scan_' || lower(regexp_replace(name, '[^a-zA-Z0-9_-]', '_', 'g')) || '_' || {_36('ms')} AS scan_id FROM n""")
oracle("slugs", "p_partkey b, slug s, falsy s, nullish s, short s, signed s", f"""SELECT p_partkey, lower(regexp_replace(p_type || '  ' || p_name, '{B}s+', '-', 'g')) AS slug,
 CASE WHEN p_size > 25 OR p_name = '' THEN 'none' ELSE p_name END AS falsy, CASE WHEN p_size > 25 THEN '' ELSE p_name END AS nullish,
 CASE WHEN length(p_name) <= 6 THEN p_name ELSE '\u2026' || right(p_name, 5) END AS short, {_SIGNED('(p_size - 25)')} AS signed FROM part""")
oracle("key_audit", "c_custkey b, token_hash s, email_ok o", "SELECT c_custkey, sha256(c_name) AS token_hash, c_custkey % 4 = 0 AS email_ok FROM customer")

# --- history, retention, accounts ----------------------------------------------------------------------------------------

_SCANS = "scans AS (SELECT cast(event_id AS varchar) AS scan_id, ts AS created_at, cast(floor(value) AS bigint) AS flagged_units, event_id % 4 AS critical, event_id % 9 AS high FROM events WHERE event_type = 'purchase')"
_KEPT = f"{_SCANS}, kept AS (SELECT * FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 20)"
_SF = f"{FINDINGS}, sf AS (SELECT cast(l_orderkey % 10000 AS varchar) AS scan_id, id, severity FROM findings)"
oracle("scan_retention", "scan_id s, findings b", f"WITH {_KEPT}, {_SF} --FINAL SELECT scan_id, count(*) AS findings FROM sf WHERE scan_id IN (SELECT scan_id FROM kept) GROUP BY scan_id")
oracle("kept_scans", "scan_id s, flagged_units b", f"WITH {_KEPT} --FINAL SELECT scan_id, flagged_units FROM kept")
_LATEST = f"{_SCANS}, {_SF}, latest AS (SELECT * FROM sf WHERE scan_id = (SELECT scan_id FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 1))"
oracle("latest_findings", "scan_id s, id s, severity s", f"WITH {_LATEST} --FINAL SELECT * FROM latest")
oracle("findings_summary", "critical b, high b, medium b, low b, total b", f"WITH {_LATEST} --FINAL SELECT "
       + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in fixed.SEVERITIES) + ", count(*) AS total FROM latest")
oracle("scan_added", "scan_id s, findings b", f"WITH {_KEPT}, {_SF} --FINAL SELECT scan_id, (SELECT count(*) FROM sf WHERE sf.scan_id = kept.scan_id) AS findings FROM kept")
_TOLD = lambda source, name: f"SELECT '{source}' AS source, severity, count(*) AS findings, 3 AS most_signals, sum(ai_score) AS ai_scores FROM {name} GROUP BY severity"
oracle("api_findings", "source s, severity s, findings b, most_signals b, ai_scores b", f"WITH a AS ({ORACLES['invalid_api_findings']}), b AS ({ORACLES['secret_findings']}) --FINAL "
       + _TOLD("hallucination-detector", "a") + " UNION ALL " + _TOLD("secret-detector", "b"))
oracle("report_documents", "path s, units b, findings b, first_id s", f"""WITH {FINDINGS}, {UNITS}, u AS (SELECT path, count(*) AS n FROM units GROUP BY path),
f AS (SELECT file, count(*) AS n, arg_min(id, (line, id)) AS first_id FROM findings GROUP BY file)
--FINAL SELECT coalesce(path, file) AS path, coalesce(u.n, 0) AS units, coalesce(f.n, 0) AS findings, first_id FROM u FULL JOIN f ON path = file""")
oracle("findings_written", "severity s, findings b, lines b, first_id s", f"WITH {FINDINGS} --FINAL SELECT severity, count(*) AS findings, sum(line) AS lines, min(id) AS first_id FROM findings GROUP BY severity")
oracle("snapshot_replaced", "severity s, findings b, scanned s", f"WITH {FINDINGS} --FINAL SELECT severity, count(*) AS findings, '2024-01-02' AS scanned FROM findings WHERE current GROUP BY severity")
oracle("calibration_written", _SWEEP_SPEC, f"WITH {_SWEEP} --FINAL SELECT * FROM sweep")
oracle("dashboard_totals", "critical b, high b, flagged_units b", f"WITH {_SCANS} --FINAL SELECT sum(critical) AS critical, sum(high) AS high, sum(flagged_units) AS flagged_units FROM scans")
_Z = lambda c, n: f"CASE WHEN scan % 10 = 0 THEN 0 ELSE {c} END AS {n}"
oracle("scan_rows", "scan b, status s, files_scanned b, total_units b, flagged_units b, ai_percentage b, critical b, high b, medium b, low b, scan_id s", f"""WITH {FINDINGS},
g AS (SELECT l_orderkey % 500 AS scan, count(DISTINCT file) AS files, count(*) AS n, count(*) FILTER (current) AS fl,
 {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in fixed.SEVERITIES)} FROM findings GROUP BY 1)
--FINAL SELECT scan, CASE WHEN scan % 10 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, {_Z('files', 'files_scanned')}, {_Z('n', 'total_units')},
 {_Z('fl', 'flagged_units')}, {_Z(rnd('fl / n * 100'), 'ai_percentage')}, {', '.join(_Z(s, s) for s in _SEV)},
 'scan_repo_' || scan || '_' || {_36('(1700000000000 + scan * 1000)')} AS scan_id FROM g""")
_HIST = f"hist AS (SELECT event_id AS seq, {qs.HISTORY_SQL.format(s='varchar')} AS line FROM events), solid AS (SELECT * FROM hist WHERE trim(line) <> '')"
_RECENT = lambda n: f"{_HIST}, last_ AS (SELECT * FROM solid ORDER BY seq DESC LIMIT {n}), good AS (SELECT seq, cast(line AS json) AS r FROM last_ WHERE json_valid(line))"
oracle("history_recent", "seq b, timestamp s, mode s, target s, blocked o, filesScanned b, aiScore s", f"""WITH {_RECENT(40)} --FINAL SELECT seq, {_js('timestamp')} AS timestamp,
 {_js('mode')} AS mode, {_js('target')} AS target, {_js('blocked')} AS blocked, {_js('filesScanned')} AS "filesScanned", {_js('aiScore')} AS "aiScore" FROM good""")
oracle("history_retained", "seq b, line s", f"WITH {_HIST} --FINAL SELECT * FROM solid ORDER BY seq DESC LIMIT 300")
oracle("history_lines", "seq b, label s", f"""WITH {_RECENT(300)} --FINAL SELECT seq, {_js('mode')} || ' ' || substring({_js('timestamp')}, 12, 5) || ' ' ||
 CASE WHEN {_js('blocked')} = 'true' THEN 'blocked' ELSE 'pass' END || ' ' || {rnd('cast(' + _js('aiScore') + ' AS double)')} AS label FROM good""")
_PCT = lambda a, b: f"CASE WHEN {b} <> 0 THEN {rnd(f'({a} - {b}) / abs({b}) * 100')} END"
oracle("scan_trend", "target b, seq b, score b, prev_score b, first_score b, direction s, change_from_previous b, change_from_first b", f"""WITH h AS (SELECT user_id AS target, event_id AS seq,
 {rnd('value')} AS score, ts FROM events),
w AS (SELECT target, seq, score, lag(score) OVER o AS prev_score, first_value(score) OVER o AS first_score FROM h WINDOW o AS (PARTITION BY target ORDER BY ts, seq))
--FINAL SELECT *, CASE WHEN prev_score IS NULL OR score = prev_score THEN 'stable' WHEN score > prev_score THEN 'increasing' ELSE 'decreasing' END AS direction,
 {_PCT('score', 'prev_score')} AS change_from_previous, {_PCT('score', 'first_score')} AS change_from_first FROM w""")
oracle("rate_limit_audit", "user_id b, event_id b, in_last_hour b", """WITH l AS (SELECT user_id % 3 AS user_id, event_id, cast(floor(epoch(ts)) AS bigint) AS sec FROM events),
c AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_last_hour FROM l)
--FINAL SELECT * FROM c WHERE in_last_hour > 7""")
oracle("scan_status", "scan_id b, status s", """SELECT user_id AS scan_id, CASE arg_max(event_type, ts) WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'RUNNING'
 WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM events GROUP BY user_id""")
oracle("repo_size_gate", "repo s, bytes b, files b", """WITH s AS (SELECT source AS repo, sum(n_chars) AS bytes, count(*) AS files FROM documents GROUP BY source)
--FINAL SELECT * FROM s WHERE bytes <= (SELECT floor(avg(n_chars) * 48) FROM documents)""")
_CASES = {"camel": r"^[a-z][a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+$", "snake": r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$", "pascal": r"^[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)*$"}
_BASE = f"""{DOC_FIGURES}, d AS (SELECT fig.*, docs.source, 1 + len(regexp_extract_all({_OPS.replace('code', 'docs.code')}, '{B}b(?:if|for|while|case){B}b|{B}?{B}?|{B}|{B}||&&')) AS complexity
 FROM fig JOIN docs ON fig.k = docs.doc_id),
base AS (SELECT source, count(*) AS units, avg(ident_entropy) AS entropy_mean, stddev_pop(ident_entropy) AS entropy_stddev, avg(comment_ratio) AS comment_mean,
 stddev_pop(comment_ratio) AS comment_stddev, {', '.join(f"sum(len(list_filter(ids, lambda w: regexp_matches(w, {q(p)})))) AS {c}_names" for c, p in _CASES.items())},
 avg(complexity) AS mean_complexity, avg(loc) AS mean_loc FROM d GROUP BY source)"""
oracle("repo_fingerprint", "source s, units b, entropy_mean d, entropy_stddev d, comment_mean d, comment_stddev d, camel_names b, snake_names b, pascal_names b, mean_complexity d, mean_loc d",
       f"WITH {_BASE} --FINAL SELECT * FROM base")
_DIST = lambda x, m, s: f"CASE WHEN {s} > 1e-9 THEN abs({x} - {m}) / {s} ELSE 0 END"
oracle("baseline_deviation", "doc_id b, source s, entropy_deviation d, comment_deviation d", f"""WITH {_BASE} --FINAL SELECT k AS doc_id, d.source,
 {_DIST('ident_entropy', 'entropy_mean', 'entropy_stddev')} AS entropy_deviation, {_DIST('comment_ratio', 'comment_mean', 'comment_stddev')} AS comment_deviation
 FROM d JOIN base ON d.source = base.source""")
oracle("scanner_notes", "level s, text s, seq b", f"""WITH n AS (SELECT conv_id * 1000 + turn AS seq, CASE WHEN role = 'user' THEN 'warn' ELSE 'log' END AS level,
 CASE turn % 4 WHEN 0 THEN role || ' skipped' WHEN 1 THEN 'note ' || role WHEN 2 THEN '{fixed.DOCKER_DOWN_NOTE}'
 ELSE coalesce(nullif({TRIM("split_part(ltrim(regexp_replace(substring(text, 1, 12), '^[" + chr(92) + "s]+', '')), chr(10), 1)")}, ''), substring(text, 1, 12)) END AS text FROM conversations)
--FINAL SELECT level, text, min(seq) AS seq FROM n GROUP BY level, text""")
oracle("registry_run", "source s, severity s, ai_score b, findings b", "WITH " + ", ".join(
    f"{n} AS ({ORACLES[o]})" for n, o in (("a1", "norm_semgrep"), ("a2", "norm_eslint"), ("a3", "norm_npm_modern"), ("a5", "norm_bearer"))
) + """, every AS (SELECT 'semgrep' AS source, severity FROM a1 UNION ALL SELECT 'eslint', severity FROM a2
 UNION ALL SELECT 'npm-audit', severity FROM a3 WHERE severity IN ('HIGH', 'CRITICAL') UNION ALL SELECT 'bearer', severity FROM a5)
--FINAL SELECT source, severity, 9 AS ai_score, count(*) AS findings FROM every GROUP BY source, severity""")

# --- accounts and streams ------------------------------------------------------------------------------------------------

oracle("session_validity", "event_id b, user_id b, email s", """SELECT event_id, user_id, c_name AS email FROM events JOIN customer ON c_custkey = user_id
WHERE event_type <> 'error' AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'""")


def _replay(user: str) -> str:
    """The account's state row by row: a recursive statement, independent of the chained form."""
    return f"""WITH RECURSIVE a AS (SELECT {user} AS user_id, epoch_us(ts) AS us, event_type = 'signup' AS ok,
 row_number() OVER (PARTITION BY {user} ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'signup')),
step AS (SELECT user_id, 0 AS rn, 0 AS failed, cast(0 AS bigint) AS until_us, false AS locked, cast(0 AS bigint) AS us FROM (SELECT DISTINCT user_id FROM a)
 UNION ALL SELECT a.user_id, a.rn,
  CASE WHEN s.until_us > a.us THEN s.failed WHEN a.ok OR s.failed + 1 >= 5 THEN 0 ELSE s.failed + 1 END,
  CASE WHEN s.until_us <= a.us AND NOT a.ok AND s.failed + 1 >= 5 THEN a.us + 900000000 ELSE s.until_us END,
  s.until_us <= a.us AND NOT a.ok AND s.failed + 1 >= 5, a.us
 FROM step s JOIN a ON a.user_id = s.user_id AND a.rn = s.rn + 1)
--FINAL SELECT user_id, us AS locked_at_us FROM step WHERE locked"""


oracle("lockout_replay", "user_id b, locked_at_us b", _replay("user_id"))
oracle("lockout_replay_shared", "user_id b, locked_at_us b", _replay("(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 5 END)"))
_SESSIONS = """WITH g AS (SELECT user_id AS target, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY us) AS no FROM g)
--FINAL SELECT target, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS scans FROM n GROUP BY target, no"""
_SESSION_SPEC = "target b, start_us b, end_us b, scans b"
oracle("activity_sessions", _SESSION_SPEC, _SESSIONS)
oracle("progress_fold", "scan_id b, processed b, total b, findings b", """SELECT user_id AS scan_id,
 arg_max(event_id % 1000, event_id) FILTER (event_type <> 'view') AS processed, arg_max(1000 + event_id % 3, event_id) AS total,
 coalesce(sum(event_id % 4) FILTER (event_type IN ('click', 'signup')), 0) AS findings FROM events GROUP BY user_id""")
oracle("stream_score", "doc_id b, points b, score b, flagged o, band s",
       f"WITH {DOC_SCORES} --FINAL SELECT k AS doc_id, points, score, flagged, band FROM scored")
oracle("stream_finding_rate", "start_us b, end_us b, severity s, findings b", """WITH e AS (SELECT epoch_us(ts) AS us,
 CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events),
w AS (SELECT severity, unnest([us // 10800000000 * 10800000000, (us // 10800000000 - 1) * 10800000000]) AS start_us FROM e)
--FINAL SELECT start_us, start_us + 21600000000 AS end_us, severity, count(*) AS findings FROM w GROUP BY start_us, severity""")
oracle("stream_dedupe", "id s, match_no b", """SELECT DISTINCT substring(sha1(event_type || ':' || json_extract_string(props, '$.k')), 1, 10) AS id,
 event_id % 3 AS match_no FROM events""")
ORACLES["stream_delta"] = ORACLES["delta_summary"]
oracle("history_text", "line s", f"""WITH l AS ({ORACLES['history_lines']})
--FINAL SELECT 'history: ' || coalesce(string_agg(label, ' | ' ORDER BY cast(seq AS bigint) DESC), 'none') AS line FROM l""")
oracle("registry_isolated", "name s, status s, findings b", f"""WITH a AS ({ORACLES['norm_semgrep']}), b AS ({ORACLES['norm_eslint']}), c AS ({ORACLES['norm_npm_modern']})
--FINAL SELECT 'semgrep' AS name, 'done' AS status, count(*) AS findings FROM a UNION ALL SELECT 'eslint', 'done', count(*) FROM b
 UNION ALL SELECT 'npmAudit', 'done', count(*) FROM c WHERE severity IN ('HIGH', 'CRITICAL') UNION ALL SELECT 'bearer', 'unavailable', 0""")
oracle("phase_rows", "phase s, rows b", f"""WITH a AS ({ORACLES['invalid_api_findings']}), b AS ({ORACLES['secret_findings']})
--FINAL SELECT 'scoring' AS phase, (SELECT count(*) FROM orders) AS rows UNION ALL
 SELECT 'securityAnalysis', (SELECT count(*) FROM a) + (SELECT count(*) FROM b) UNION ALL SELECT 'reportGeneration', 1""")
ORACLES["stream_scan_deltas"] = ORACLES["delta_series"]
oracle("snapshots_of_many_targets", "target_key s, scanned s, findings b, first_id s", """WITH e AS (SELECT cast(user_id AS varchar) AS target_key, cast(ts AS date) AS day,
 substring(sha1(event_type || ':' || (cast(json_extract_string(props, '$.k') AS int) % 5)), 1, 10) AS id FROM events),
last_ AS (SELECT target_key, max(day) AS day FROM e GROUP BY target_key)
--FINAL SELECT target_key, strftime(max(day), '%Y-%m-%d') AS scanned, count(*) AS findings, min(id) AS first_id FROM e JOIN last_ USING (target_key, day) GROUP BY target_key""")
ORACLES["stream_sessions"] = ORACLES["stream_sessions_to_the_end"] = ORACLES["activity_sessions"]
ORACLES["stream_lockouts"] = ORACLES["stream_lockouts_to_the_end"] = ORACLES["lockout_replay"]
