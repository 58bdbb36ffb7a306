"""Scanner JSON to findings.

Every function takes a table with the tool's output in column ``raw`` (one document per row)
and gives one row per finding in `RAW_COLUMNS`. Parsing fails open: text that is no JSON, or
lacks the list, gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed
from inkprint.functions.rows import explode_entries, explode_once
from inkprint.functions.scalars import (
    default_if_blank, default_if_null, default_if_zero, digest, first_matching, lookup, slug, spaced, trim_ws,
)
from inkprint.sources import schemas


def resolve_path(root: str, path: Column) -> Column:
    """Absolute form of a path: below ``root`` unless absolute, dots folded away."""
    base = root.rstrip("/")
    joined = F.when(path.startswith("/"), path).when(path == "", F.lit(base or "/")).otherwise(
        F.concat(F.lit(base + "/"), path)
    )
    folded = F.concat(
        F.lit("/"),
        F.array_join(
            F.aggregate(
                F.split(joined, "/"),
                F.array().cast("array<string>"),
                lambda done, part: F.when(part.isin("", "."), done)
                .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
                .otherwise(F.concat(done, F.array(part))),
            ),
            "/",
        ),
    )
    return F.when(joined.rlike(r"//|/\.{1,2}(?:/|$)|.+/$"), folded).otherwise(joined)


def _rows(raw: DataFrame, schema: str, items: str, keep: Sequence[str]) -> DataFrame:
    parsed = F.from_json(F.col("raw"), schema, {"mode": "PERMISSIVE"})
    listed = parsed if not items else parsed[items]
    return explode_once(raw, *keep, items=listed, name="r")


def _emit(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    order = ("id", "rule_id", "file", "line", "column", "code", "type", "message", "category", "severity")
    return df.select(*keep, *[columns[c].alias(c) for c in order])


# --- semgrep ---------------------------------------------------------------------------


def semgrep_severity(raw: Column) -> Column:
    value = F.upper(default_if_null(raw, ""))
    return (
        F.when(value.contains("ERROR") | value.contains("CRITICAL"), "CRITICAL")
        .when(value.contains("WARNING") | value.contains("HIGH"), "HIGH")
        .when(value.contains("INFO") | value.contains("MEDIUM"), "MEDIUM")
        .otherwise("LOW")
    )


def semgrep_type(rule: Column) -> Column:
    last = F.try_element_at(F.filter(F.split(rule, r"\."), lambda p: p != ""), F.lit(-1))
    return F.concat(F.lit("Semgrep "), spaced(F.coalesce(last, rule)))


def semgrep(raw: DataFrame, root: str, keep: Sequence[str] = ()) -> DataFrame:
    rows = _rows(raw, schemas.SEMGREP, "results", keep).select(
        *keep,
        resolve_path(root, default_if_null(F.col("r.path"), "")).alias("file"),
        default_if_null(F.col("r.start.line"), 1).alias("line"),
        default_if_null(F.col("r.start.col"), 1).alias("col"),
        default_if_blank(F.col("r.check_id"), "semgrep.unknown-rule").alias("rule"),
        "r",
    )
    extra = F.col("r.extra")
    return _emit(
        rows, keep,
        id=digest(10, "semgrep", F.col("file"), F.col("line"), F.col("col"), F.col("rule")),
        rule_id=F.col("rule"), file=F.col("file"), line=F.col("line"), column=F.col("col"),
        code=default_if_blank(trim_ws(extra["lines"]), ""),
        type=semgrep_type(F.col("rule")),
        message=default_if_blank(trim_ws(extra["message"]), "Semgrep finding"),
        category=default_if_blank(extra["metadata"]["category"], "code-security"),
        severity=semgrep_severity(extra["severity"]),
    )


# --- eslint ----------------------------------------------------------------------------


def eslint_rules(custom: Sequence[str] | None = None) -> tuple[str, ...]:
    """The rule set in force; a custom list keeps only rules that are known."""
    return tuple(r for r in fixed.ESLINT_RULES if not custom or r in custom)


def eslint_severity(level: Column) -> Column:
    return F.when(level == 2, "HIGH").when(level == 1, "MEDIUM").otherwise("LOW")


def eslint_category(rule: Column) -> Column:
    return (
        F.when(rule.startswith("security/"), "code-security")
        .when(rule.contains("regex"), "regex-security")
        .when(rule.contains("eval") | rule.contains("buffer"), "unsafe-code-execution")
        .otherwise("code-quality")
    )


def eslint(raw: DataFrame, root: str = "", keep: Sequence[str] = (), rules: Sequence[str] | None = None) -> DataFrame:
    files = _rows(raw, schemas.ESLINT, "", keep)
    rows = explode_once(
        files, *keep, F.col("r.filePath").alias("file"), items=F.col("r.messages"), name="m"
    ).filter(F.col("m.ruleId").isNotNull())
    rows = rows.withColumn("rule", default_if_blank(F.col("m.ruleId"), "eslint.unknown-rule"))
    if rules is not None:
        rows = rows.filter(F.col("rule").isin(*eslint_rules(rules)))
    last = default_if_blank(F.element_at(F.split("rule", "/"), -1), F.col("rule"))
    return _emit(
        rows, keep,
        id=digest(10, "eslint", F.col("file"), *(F.coalesce(F.col(c).cast("string"), F.lit(fixed.NO_VALUE)) for c in ("m.line", "m.column")), F.col("rule")),
        rule_id=F.col("rule"), file=F.col("file"), line=F.col("m.line"), column=F.col("m.column"),
        code=F.lit(""), type=F.concat(F.lit("ESLint "), spaced(last)), message=F.col("m.message"),
        category=eslint_category(F.col("rule")), severity=eslint_severity(F.col("m.severity")),
    )


# --- npm audit -------------------------------------------------------------------------


def npm_severity(raw: Column) -> Column:
    return lookup(
        F.lower(default_if_null(raw, "low")),
        {"critical": "CRITICAL", "high": "HIGH", "moderate": "MEDIUM"},
        "LOW",
    )


def npm_kept_severities(threshold: str) -> tuple[str, ...]:
    """Severities at or above a threshold; an unknown threshold keeps all."""
    order, wanted = fixed.NPM_SEVERITY_ORDER, threshold.lower()
    least = order.index(wanted) if wanted in order else -1
    mapped = {"low": "LOW", "moderate": "MEDIUM", "high": "HIGH", "critical": "CRITICAL"}
    return tuple(mapped[s] for i, s in enumerate(order) if i >= least)


def _npm_finding(rows: DataFrame, root: str, keep: Sequence[str]) -> DataFrame:
    return _emit(
        rows, keep,
        id=digest(10, "npm-audit", F.col("key"), F.col("affected")),
        rule_id=F.concat(F.lit("npm-audit:"), F.col("key")),
        file=resolve_path(root, F.lit("package.json")), line=F.lit(1), column=F.lit(1),
        code=F.concat(F.lit('"'), F.col("affected"), F.lit('"')),
        type=F.lit("Dependency Vulnerability"), message=F.col("message"),
        category=F.lit("supply-chain-security"), severity=npm_severity(F.col("level")),
    )


def npm_audit(raw: DataFrame, root: str, keep: Sequence[str] = (), threshold: str | None = "HIGH") -> DataFrame:
    """Both report layouts in one pass: each package gives an array of findings, exploded once."""
    parsed = F.from_json(F.col("raw"), schemas.NPM_AUDIT, {"mode": "PERMISSIVE"})
    packages = explode_entries(raw, *keep, entries=parsed["vulnerabilities"], key="pkg", value="v")
    pkg, v = F.col("pkg"), F.col("v")
    shape = lambda key, affected, message, level: F.struct(
        key.alias("key"), affected.alias("affected"), message.alias("message"), level.alias("level")
    )
    plain_title = F.concat(F.lit("Vulnerability in "), pkg)

    # layout with advisories: one finding per distinct path
    listed = F.flatten(F.transform(v["findings"], lambda f: F.coalesce(f["paths"], F.array().cast("array<string>"))))
    paths = F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(F.array(pkg)))
    advisory = default_if_null(v["id"], pkg)
    title = default_if_blank(trim_ws(v["title"]), plain_title)
    legacy = F.transform(
        paths,
        lambda p: shape(advisory, p, F.concat(title, F.lit(" (affected: "), p, F.lit(")")), v["severity"]),
    )

    # layout with "via": one finding per object in it, text entries only name other packages
    objects = F.transform(
        F.filter(default_if_null(v["via"], F.array().cast("array<string>")), lambda e: e.startswith("{")),
        lambda e: F.from_json(e, schemas.NPM_VIA),
    )
    affected = F.coalesce(F.try_element_at(v["nodes"], F.lit(1)), pkg)

    def via_finding(via: Column, index: Column) -> Column:
        numbered = F.concat(pkg, F.lit("-"), index.cast("string"))
        key = F.coalesce(via["source"], via["name"], numbered)
        named = F.concat(F.lit("Vulnerability in "), F.coalesce(via["name"], pkg))
        span = default_if_null(F.nullif(trim_ws(via["range"]), F.lit("")), "")
        suffix = F.when(span == "", F.lit("")).otherwise(F.concat(F.lit(" "), span))
        text = F.concat(default_if_blank(trim_ws(via["title"]), named), F.lit(" (affected: "), pkg, suffix, F.lit(")"))
        return shape(key, affected, text, F.coalesce(via["severity"], v["severity"]))

    fallback = F.array(shape(default_if_blank(trim_ws(v["name"]), pkg), affected, plain_title, v["severity"]))
    modern = F.when(F.size(objects) > 0, F.transform(objects, via_finding)).otherwise(fallback)

    either = F.when(v["findings"].isNotNull(), legacy).otherwise(modern)
    rows = explode_once(packages, *keep, items=either, name="f").select(*keep, "f.*")
    found = _npm_finding(rows, root, keep)
    return found if threshold is None else found.filter(F.col("severity").isin(*npm_kept_severities(threshold)))


# --- nodejsscan ------------------------------------------------------------------------


def nodejsscan_severity(raw: Column) -> Column:
    value = F.lower(default_if_null(raw, ""))
    return (
        F.when(value.contains("critical") | value.contains("high"), "HIGH")
        .when(value.contains("medium") | value.contains("warning"), "MEDIUM")
        .otherwise("LOW")
    )


def nodejsscan_category(issue: Column) -> Column:
    return first_matching(F.lower(issue), fixed.NODEJSSCAN_CATEGORIES, F.lit("nodejs-security"))


def nodejsscan(raw: DataFrame, root: str, keep: Sequence[str] = ()) -> DataFrame:
    rows = _rows(raw, schemas.NODEJSSCAN, "results", keep).select(
        *keep,
        resolve_path(root, default_if_null(F.col("r.file"), "")).alias("file"),
        default_if_zero(F.col("r.line"), 1).alias("line"),
        default_if_blank(F.col("r.issue"), "Node.js security issue").alias("issue"),
        "r",
    )
    return _emit(
        rows, keep,
        id=digest(10, "nodejsscan", F.col("file"), F.col("line"), F.col("issue")),
        rule_id=F.concat(F.lit("nodejsscan:"), slug(F.col("issue"))),
        file=F.col("file"), line=F.col("line"), column=F.lit(1),
        code=default_if_null(F.col("r.code"), ""), type=F.lit("Node.js Security Issue"),
        message=F.col("issue"), category=nodejsscan_category(F.col("issue")),
        severity=nodejsscan_severity(F.col("r.severity")),
    )


# --- bearer ----------------------------------------------------------------------------


def bearer_severity(raw: Column) -> Column:
    return lookup(
        F.lower(default_if_null(raw, "")), {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM"}, "LOW"
    )


def bearer_category(category: Column, data_types: Column) -> Column:
    lowered = F.lower(category)
    return F.when(F.size(data_types) > 0, "data-privacy").otherwise(
        first_matching(lowered, fixed.BEARER_CATEGORIES, slug(category))
    )


def bearer(raw: DataFrame, root: str, keep: Sequence[str] = ()) -> DataFrame:
    """Findings without a file path are dropped, as are rows without a category."""
    r = F.col("r")
    rows = _rows(raw, schemas.BEARER, "findings", keep).filter(
        (default_if_null(r["file"]["path"], "") != "") & r["category"].isNotNull()
    )
    rows = rows.select(
        *keep,
        resolve_path(root, r["file"]["path"]).alias("file"),
        default_if_zero(r["file"]["line"], 1).alias("line"),
        default_if_zero(r["file"]["column"], 1).alias("col"),
        F.coalesce(r["data_types"], F.array().cast("array<string>")).alias("kinds"),
        "r",
    )
    kinds = F.col("kinds")
    some = F.size(kinds) > 0
    said = default_if_blank(r["description"], default_if_blank(r["title"], "Bearer finding"))
    label = F.concat(F.lit("Bearer "), spaced(r["category"]))
    return _emit(
        rows, keep,
        id=digest(10, "bearer", F.col("file"), F.col("line"), default_if_null(r["title"], "undefined")),
        rule_id=F.concat(F.lit("bearer:"), slug(r["category"])),
        file=F.col("file"), line=F.col("line"), column=F.col("col"),
        code=default_if_null(r["snippet"]["code"], ""),
        type=F.when(some, F.concat(label, F.lit(" ("), F.try_element_at(kinds, F.lit(1)), F.lit(")"))).otherwise(label),
        message=F.when(
            some, F.concat(said, F.lit(" (data types: "), F.array_join(kinds, ", "), F.lit(")"))
        ).otherwise(said),
        category=bearer_category(r["category"], kinds),
        severity=bearer_severity(r["severity"]),
    )
