"""The common findings schema (N13) and the local detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.config import DEFAULT_CONFIG, ScanConfig
from inkprint.functions import text as tx
from inkprint.functions.rows import explode_once
from inkprint.functions.scalars import contains_any, digest, first_matching, lookup
from inkprint.operators.score import explained, no_explanation

# What a scanner reports, and what the engine adds to it.
RAW_COLUMNS = ("id", "rule_id", "file", "line", "column", "code", "type", "message", "category", "severity")
FINDING_COLUMNS = (
    "id", "severity", "type", "category", "message", "file", "line", "column", "code",
    "ai_score", "explained", "source", "rule_id",
)


def to_common(raw: DataFrame, source: str, config: ScanConfig, keep: Sequence[str] = ()) -> DataFrame:
    """Scanner findings in the common schema, scored with the threshold until attributed."""
    return raw.select(
        *keep, "id", "severity", "type", "category", "message", "file", "line", "column", "code",
        F.lit(config.threshold).alias("ai_score"),
        no_explanation(config.threshold).alias("explained"),
        F.lit(source).alias("source"),
        "rule_id",
    )


def _matches(code: Column, rules: Mapping[str, str], guard: str = "") -> Column:
    """Array of (rule, match) for every match of every rule: the rules live in the plan."""

    def tagged(rule: str, pattern: str) -> Column:
        named = lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match"))
        return F.transform(tx.every(code, guard + pattern), named)

    return F.concat(*[tagged(rule, pattern) for rule, pattern in rules.items()])


def invalid_calls(code: Column) -> Column:
    """Calls of functions their library does not have, with repeats."""
    return _matches(code, fixed.INVALID_CALLS, guard=fixed.WORD_START)


def literals(code: Column) -> Column:
    """String literals without their quotes."""
    quoted = tx.every(code, fixed.LITERAL)
    return F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2))


def literal_entropy(literal: Column) -> Column:
    return tx.short_text_entropy(literal)


def is_harmless(literal: Column) -> Column:
    """URLs, paths, messages and CSS colours look random but give nothing away."""
    return literal.rlike(fixed.HARMLESS_LITERAL)


def is_random(literal: Column) -> Column:
    """Long and of high entropy, or forty hex digits (whose entropy cannot reach the cut)."""
    spread = (F.length(literal) > fixed.LITERAL_MIN_LENGTH) & (literal_entropy(literal) > fixed.LITERAL_ENTROPY)
    return ~is_harmless(literal) & (literal.rlike(fixed.HEX_LITERAL) | spread)


def secrets(code: Column) -> Column:
    """Array of (rule, match): the pattern rules, then random-looking literals."""
    random_ones = F.transform(
        F.filter(literals(code), is_random),
        lambda text: F.struct(F.lit("high-entropy-literal").alias("rule"), text.alias("match")),
    )
    return F.concat(_matches(code, fixed.SECRET_RULES), random_ones)


def severity_for(kind: Column, score: Column) -> Column:
    """Kind of finding against the score of the code it sits in."""
    above = lookup(kind, {k: v[0] for k, v in fixed.SEVERITY_BY_KIND.items()})
    below = lookup(kind, {k: v[1] for k, v in fixed.SEVERITY_BY_KIND.items()})
    return F.when(score >= fixed.HIGH_RISK_SCORE, above).otherwise(below)


def rule_category(rule_id: Column, default: str = "code-quality") -> Column:
    """The unified category of a rule."""
    return first_matching(F.lower(rule_id), tuple(fixed.RULE_TAXONOMY.items()), F.lit(default))


def local_matches(config: ScanConfig = DEFAULT_CONFIG) -> Column:
    """D3: what the switched-on detectors see in a scored unit.

    Array of (detector, rule, match). The invalid-call rules look at flagged units only; the
    gate is a CASE around the search, so unflagged units skip it and no filter repeats the
    scoring.
    """
    tagged = lambda found, name: F.transform(
        found, lambda m: F.struct(F.lit(name).alias("detector"), m["rule"].alias("rule"), m["match"].alias("match"))
    )
    nothing = F.array().cast("array<struct<detector:string,rule:string,match:string>>")
    parts = []
    if config.secret_detection:
        parts.append(tagged(secrets(F.col("code")), "secret-detector"))
    if config.hallucination_detection:
        calls = tagged(invalid_calls(F.col("code")), "hallucination-detector")
        parts.append(F.when(F.col("flagged"), calls).otherwise(nothing))
    return F.concat(*parts) if parts else nothing


def local_severity(detector: Column, score: Column) -> Column:
    high = score >= fixed.HIGH_RISK_SCORE
    return (
        F.when(detector == "secret-detector", F.when(high, "CRITICAL").otherwise("HIGH"))
        .otherwise(F.when(high, "HIGH").otherwise("MEDIUM"))
    )


def local_findings(scored: DataFrame, config: ScanConfig = DEFAULT_CONFIG, keep: Sequence[str] = ()) -> DataFrame:
    """Findings of the detectors on scored units, one row per match (no shuffle).

    ``match_no`` numbers the matches of one unit: the id alone repeats when a call does.
    """
    found = explode_once(
        scored, *keep, "path", "start_line", "score", explained().alias("explained"),
        items=local_matches(config), name="found", position="match_no",
    )
    is_secret = F.col("found.detector") == "secret-detector"
    return found.select(
        *keep,
        "match_no",
        digest(
            10,
            F.when(is_secret, F.concat(F.lit("secret:"), F.col("found.rule"))).otherwise("hallucination"),
            F.col("path"), F.col("start_line"), F.col("found.match"),
        ).alias("id"),
        local_severity(F.col("found.detector"), F.col("score")).alias("severity"),
        F.when(is_secret, "Hardcoded secret").otherwise("Hallucinated API call").alias("type"),
        F.when(is_secret, "credential-exposure").otherwise("runtime-failure").alias("category"),
        F.when(is_secret, F.concat(F.lit("Possible secret in source: "), F.col("found.rule")))
        .otherwise(F.concat(F.col("found.rule"), F.lit(" is not part of the known API surface.")))
        .alias("message"),
        F.col("path").alias("file"),
        F.col("start_line").alias("line"),
        F.lit(1).alias("column"),
        F.col("found.match").alias("code"),
        F.col("score").alias("ai_score"),
        "explained",
        F.col("found.detector").alias("source"),
        F.when(is_secret, F.concat(F.lit("secret."), F.col("found.rule")))
        .otherwise("hallucination.invalid-api-call").alias("rule_id"),
    )


# --- D9: imports against a catalogue ---------------------------------------------------

_ID = "[A-Za-z_$][A-Za-z0-9_$]*"
_QUOTED = r"[\"'][^\"'\n]+[\"']"
# import and export with a module, and calls of require or import, with the names they are bound to
_IMPORT = (
    rf"{fixed.WORD_START}(?:import|export)(?![A-Za-z0-9_$(])\s*(?:type\s+(?!from))?(?:[^;'\"()=]*?\s*(?<![A-Za-z0-9_$])from\s*)?{_QUOTED}"
    rf"|(?:{fixed.WORD_START}(?:const|let|var)\s+(?:{_ID}|\{{[^}}]*\}})\s*=\s*(?:await\s+)?)?{fixed.WORD_START}(?:require|import)\(\s*{_QUOTED}\s*\)"
)
_AFTER_FROM = r"\s*[\"']"


def bindings(units: DataFrame) -> DataFrame:
    """The symbol table of every file: ``path, module, kind, export, local``.

    ``kind`` is ``named`` (an export, by its own or another name), ``default``, ``namespace`` (a
    name for the whole module) or ``module`` (nothing is bound). Re-exports bind no local name.
    Modules of the same repository (relative or absolute paths) are left out.
    """
    statement = explode_once(units, "path", items=tx.every(F.col("code"), _IMPORT), name="statement")
    text = F.col("statement")
    passes_on = text.startswith("export")
    row = lambda kind, export, local: F.struct(
        F.lit(kind).alias("kind"), export.cast("string").alias("export"), F.nullif(local, F.lit("")).alias("local")
    )
    none = F.lit(None).cast("string")
    pieces = F.filter(F.split(F.regexp_extract(text, r"\{([^}]*)\}", 1), ","), lambda p: p.rlike("[A-Za-z_$]"))
    one = lambda p, group: F.regexp_extract(F.regexp_replace(p, rf"\s+as\s+(?={_ID}\s*$)", ":"), rf"^\s*(?:type\s+)?({_ID})\s*(?::\s*({_ID}))?", group)
    named = F.transform(
        pieces, lambda p: row("named", one(p, 1), F.when(passes_on, none).otherwise(F.coalesce(F.nullif(one(p, 2), F.lit("")), one(p, 1))))
    )
    single = lambda kind, export, pattern: F.filter(
        F.array(row(kind, export, F.regexp_extract(text, pattern, 1))), lambda r: r["local"].isNotNull()
    )
    whole = single("namespace", none, rf"^import[^*]*\*\s*as\s+({_ID})")
    assigned = single("namespace", none, rf"^(?:const|let|var)\s+({_ID})\s*=")
    default = single("default", F.lit("default"), rf"^import\s+(?:type\s+)?({_ID})\s*(?:,|from{_AFTER_FROM})")
    bound = F.concat(default, named, whole, assigned)
    found = F.when(F.size(bound) > 0, bound).otherwise(F.array(row("module", none, none)))
    table = statement.select(
        "path", F.regexp_extract(text, r"[\"']([^\"'\n]+)[\"']\s*\)?$", 1).alias("module"), F.explode_outer(found).alias("b")
    )
    return table.select("path", "module", "b.kind", "b.export", "b.local").filter(
        ~F.col("module").startswith(".") & ~F.col("module").startswith("/")
    )


def imports(units: DataFrame) -> DataFrame:
    """One row per imported name: ``module`` and ``export`` (null for the whole module or its default)."""
    return bindings(units).select("path", "module", F.when(F.col("kind") == "named", F.col("export")).alias("export"))


def unknown_imports(units: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Imports the catalogue (``module``, ``export``) does not hold.

    Unknown modules, and unknown names of known modules.
    """
    used = imports(units).distinct()
    # the right sides of semi and anti joins stay as they are: a distinct on the join key would keep
    # adaptive execution from splitting a module that most units import
    modules = catalogue.select("module")
    missing = used.select("path", "module").join(modules, "module", "left_anti").distinct()
    named = used.filter(F.col("export").isNotNull()).join(modules, "module", "left_semi")
    bad = named.join(catalogue.select("module", "export"), ["module", "export"], "left_anti").distinct()
    finding = lambda df, key, export, message, rule: df.select(
        digest(10, "import", F.col("path"), key).alias("id"),
        F.col("path").alias("file"), "module", export.alias("export"), message.alias("message"),
        F.lit(rule).alias("rule_id"),
    )
    return finding(
        missing, F.col("module"), F.lit(None).cast("string"),
        F.concat(F.col("module"), F.lit(" is not an installed package.")), "hallucination.unknown-package",
    ).unionByName(
        finding(
            bad, F.concat_ws(".", "module", "export"), F.col("export"),
            F.concat(F.col("export"), F.lit(" is not exported by "), F.col("module")),
            "hallucination.unknown-export",
        )
    )


def unknown_members(units: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls ``module.member(`` on a catalogued module that has no such member."""
    call = rf"{fixed.WORD_START}[A-Za-z_$][A-Za-z0-9_$]*\.[A-Za-z_$][A-Za-z0-9_$]*\s*(?=\()"
    calls = explode_once(units, "path", items=tx.every(F.col("code"), call), name="call").select(
        "path",
        F.substring_index("call", ".", 1).alias("module"),
        F.rtrim(F.substring_index("call", ".", -1)).alias("export"),
    ).distinct()  # a module that every unit calls comes once per unit and member
    known = calls.join(catalogue.select("module"), "module", "left_semi")
    return known.join(catalogue.select("module", "export"), ["module", "export"], "left_anti").distinct()


def unknown_bound_calls(units: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls of members that a catalogued module does not have, through whatever name the file gave the module.

    ``path, module, export, local``: the name in front of the dot is looked up in the file's symbol
    table, so that aliases are followed and names of other things are left alone.
    """
    call = rf"{fixed.WORD_START}{_ID}\.{_ID}\s*(?=\()"
    calls = explode_once(units, "path", items=tx.every(F.col("code"), call), name="call").select(
        "path", F.substring_index("call", ".", 1).alias("local"), F.rtrim(F.substring_index("call", ".", -1)).alias("export")
    ).distinct()
    names = bindings(units).filter("kind IN ('default', 'namespace')").select("path", "local", "module").distinct()
    known = calls.join(names, ["path", "local"]).join(catalogue.select("module"), "module", "left_semi")
    return known.join(catalogue.select("module", "export"), ["module", "export"], "left_anti").select("path", "module", "export", "local").distinct()


# --- D10 ---------------------------------------------------------------------------------


def without_suppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drops findings whose id is suppressed."""
    ids = suppressions.select(F.col("finding_id").alias("id"))
    return findings.join(ids, "id", "left_anti")
