"""The registered batch queries: each is an operator run over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint import fixed, merge_config
from inkprint.functions import scalars as sx
from inkprint.functions import text as tx
from inkprint.functions import urls
from inkprint.functions.rows import explode_once
from inkprint.operators import accounts as ac
from inkprint.operators import attribute as at
from inkprint.operators import calibrate as cal
from inkprint.operators import delta as dl
from inkprint.operators import findings as fd
from inkprint.operators import history as hs
from inkprint.operators import normalize as nz
from inkprint.operators import paths as pt
from inkprint.operators import report as rp
from inkprint.operators import score as sc
from inkprint.operators import signals as sg
from inkprint.operators import units as un
from inkprint.plans import rawjson
from inkprint.plans import tables as tb
from inkprint.session import cut_lineage, work_folder
from inkprint.sources import tables as ts
from inkprint.streaming import jobs, sinks
from inkprint.streaming.lockout import lock_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ROOT = "/work/repo"
SCAN_PARTS = "spark.inkprint.scanParts"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the tables hold times without a zone; results are compared as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return tidy(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions rounded to six places."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan out to as many parts as ``spark.inkprint.scanParts`` says; as it is read without.

    For tables of one small file, which one task would read. The setting is the caller's.
    """
    parts = df.sparkSession.conf.get(SCAN_PARTS, None)
    return df.repartition(int(parts)) if parts else df


def parts_of(spark: SparkSession) -> int:
    """Parts for costly work on rows that take little room: those asked for, or one per shuffle partition and core at least."""
    asked = spark.conf.get(SCAN_PARTS, None)
    return int(asked) if asked else max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame) -> DataFrame:
    """The narrow rows of a scan in as many parts as there are tasks to keep busy.

    A file is read by one task per row group, and adaptive execution goes by bytes: both leave few
    tasks where a row of some bytes becomes a text that is searched.
    """
    return df.repartition(parts_of(df.sparkSession))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = tb.unit_columns("spark")
    narrow = dealt(tb.read(spark, sf_dir, "orders").select("o_orderkey"))
    return narrow.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(tb.document_units(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score_units(units(spark, sf_dir))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score_units(documents(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant, whatever the file says about time zones (session zone is UTC)."""
    return tb.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


W = fixed.SIGNAL_WEIGHTS
DAY = lambda: F.date_trunc("day", F.col("ts"))

# --- signals ---------------------------------------------------------------------------


@query
def sig_perplexity(spark, sf_dir):
    figured = sg.perplexity_figures(documents(spark, sf_dir))
    return figured.select(
        "doc_id", "token_count", "token_entropy", "token_repetition",
        sg.BY_NAME["perplexity"].score(W["perplexity"]).alias("score"),
    )


@query
def sig_burstiness(spark, sf_dir):
    figured = sg.burstiness_figures(documents(spark, sf_dir))
    return figured.select(
        "doc_id", "sentence_count", "worded_count", "sentence_cv", "opener_variety",
        sg.BY_NAME["burstiness"].score(W["burstiness"]).alias("score"),
    )


@query
def sig_comment_ratio(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "unit_key", "loc", "comment_lines", "comment_ratio", F.col("s_commentRatio").alias("score")
    )


@query
def sig_generic_names(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "unit_key", "ident_count", "ident_generic", F.col("s_genericNames").alias("score")
    )


@query
def sig_naming_entropy(spark, sf_dir):
    return scored(spark, sf_dir).select("unit_key", "ident_entropy", F.col("s_namingEntropy").alias("score"))


@query
def sig_formatting(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "unit_key", "indent_lines", "indent_levels", F.col("s_formattingUniformity").alias("score")
    )


@query
def sig_regex_family(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "unit_key", "null_checks", "helper_definitions", "boilerplate_hits",
        *[F.col(f"s_{n}").alias(n.lower()) for n in (
            "obviousComments", "emptyCatch", "nullChecks", "universalJsdoc", "boilerplatePatterns",
            "helperOrdering", "emojiComments",
        )],
    )


@query
def score_units(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "unit_key", "points", "score", "flagged", "band",
        sc.signals_triggered().alias("signals_triggered"), sc.score_variance().alias("variance"),
    )


@query
def score_documents(spark, sf_dir):
    return scored_documents(spark, sf_dir).select(
        "doc_id", *[F.col(c).alias(c.lower()) for c in sg.SIGNAL_COLUMNS], "points", "score", "flagged", "band"
    )


@query
def top_signals(spark, sf_dir):
    tops = explode_once(scored(spark, sf_dir), "unit_key", items=sc.top_signals(), name="top", position="place")
    return tops.select("unit_key", (F.col("place") + 1).alias("place"), "top.signal", "top.contribution", "top.score")


EVIDENCE = tuple(s.name for s in sg.SIGNALS)


@query
def signal_evidence(spark, sf_dir):
    return scored(spark, sf_dir).select("unit_key", *[sg.BY_NAME[n].evidence().alias(n.lower()) for n in EVIDENCE])


@query
def weight_override(spark, sf_dir):
    config = merge_config(threshold=42, weights={"genericNames": 99, "commentRatio": 3})
    return sc.score_units(units(spark, sf_dir), config).select(
        "unit_key", F.col("s_genericNames").alias("generic_names"), F.col("s_commentRatio").alias("comment_points"),
        "points", "score", "flagged",
    )


@query
def flagged_units(spark, sf_dir):
    strict = sc.score_units(units(spark, sf_dir), merge_config(threshold=20))
    return sc.listed_units(strict).select("unit_key", "path", "name", "score")


# --- unit features -------------------------------------------------------------------------


@query
def unit_features(spark, sf_dir):
    code = F.col("code")
    kept = un.large_enough(units(spark, sf_dir))
    return kept.select(
        "unit_key",
        un.unit_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name")).alias("id"),
        tx.code_lines(code).alias("loc"), tx.comment_lines(code).alias("comment_lines"),
        un.comment_ratio(tx.comment_lines(code), tx.code_lines(code)).alias("comment_ratio"),
        un.has_doc_comment(F.col("prefix")).alias("has_doc"),
        F.array_join(tx.snippet(code, 3), "|").alias("snippet"),
    )


@query
def lexical_complexity(spark, sf_dir):
    code = F.col("code")
    return units(spark, sf_dir).select(
        "unit_key", un.complexity(code).alias("complexity"), un.nesting_depth(code).alias("nesting_depth"),
        F.array_join(un.parameters(code), ",").alias("parameters"),
        F.array_join(tx.identifiers(code), " ").alias("identifiers"),
    )


@query
def lexical_units(spark, sf_dir):
    files = tb.derived_files(spark, sf_dir, parts_of(spark))
    return un.split_files(files).select(
        "path", "name", "kind", "start_line", "end_line",
        un.unit_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name")).alias("id"),
        F.sha1("code").alias("code_sha"),
    )


@query
def expression_units(spark, sf_dir):
    files = tb.views_of(dealt(tb.read(spark, sf_dir, "orders").select("o_orderkey")))
    return un.split_files(files).select(
        "path", "name", "kind", "start_line", "end_line",
        un.unit_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name")).alias("id"), "code",
    )


@query
def distinct_counts(spark, sf_dir):
    staged = documents(spark, sf_dir).select(
        "doc_id", tx.run_statistics(tx.tokens(F.col("code"))).alias("words"),
        F.size(F.array_distinct(tx.indents(F.col("code")))).alias("indents"),
        F.size(F.array_distinct(F.transform(tx.sentence_statistics(tx.sentence_tokens(F.col("code"))), lambda s: s["opener"]))).alias("openers"),
    )
    return staged.select("doc_id", F.col("words.distinct").alias("words"), "indents", "openers")


# --- detectors ---------------------------------------------------------------------------------


@query
def invalid_api_findings(spark, sf_dir):
    only_calls = merge_config(secret_detection=False)
    found = fd.local_findings(scored(spark, sf_dir), only_calls, keep=["unit_key"])
    return found.select("unit_key", "match_no", "id", "severity", "file", "line", "code", "message", "ai_score", "rule_id")


@query
def secret_findings(spark, sf_dir):
    only_secrets = merge_config(hallucination_detection=False)
    found = fd.local_findings(scored(spark, sf_dir), only_secrets, keep=["unit_key"])
    return found.select("unit_key", "id", "severity", "file", "line", "code", "ai_score", "rule_id")


@query
def document_secrets(spark, sf_dir):
    found = explode_once(documents(spark, sf_dir), "doc_id", items=fd.secrets(F.col("code")), name="s")
    return found.groupBy("doc_id", F.col("s.rule").alias("rule")).agg(F.count("*").alias("hits"))


@query
def entropy_literals(spark, sf_dir):
    texts = documents(spark, sf_dir).select("doc_id", "code").unionByName(
        units(spark, sf_dir).select(F.col("unit_key").alias("doc_id"), "code")
    )
    every = explode_once(texts, "doc_id", items=fd.literals(F.col("code")), name="literal")
    return every.filter(fd.is_random(F.col("literal"))).select(
        "doc_id", "literal", fd.literal_entropy(F.col("literal")).alias("entropy")
    )


@query
def rule_matches(spark, sf_dir):
    found = explode_once(units(spark, sf_dir), "unit_key", items=fd.invalid_calls(F.col("code")), name="m")
    return found.groupBy("unit_key", F.col("m.rule").alias("rule")).agg(F.count("*").alias("hits"))


@query
def severity_matrix(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        "unit_key",
        F.expr("case unit_key % 4 when 0 then 'secret' when 1 then 'known-vulnerability' "
               "when 2 then 'insecure-pattern' else 'code-quality' end").alias("kind"),
        (F.col("score") * 2).alias("score"),
        F.expr("case unit_key % 7 when 0 then 'x.sql-run' when 1 then 'hardcoded-token' when 2 then 'detect-eval' "
               "when 3 then 'md5-use' when 4 then 'pii-log' when 5 then 'cors-any' else 'style' end").alias("rule"),
    )
    return rows.select(
        "unit_key", "kind", "score", fd.severity_for(F.col("kind"), F.col("score")).alias("severity"),
        fd.rule_category(F.col("rule")).alias("category"),
    )


@query
def suppressed_findings(spark, sf_dir):
    found = tb.derived_findings(spark, sf_dir)
    # a suppression per part whose key ends in 3
    ids = tb.read(spark, sf_dir, "part").filter("p_partkey % 10 = 3").select(
        F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"), "p_partkey"
    ).select(F.substring(F.sha1(F.concat(F.lit("lineitem:"), F.col("p_partkey").cast("string"), F.lit(":"),
                                         F.col("line").cast("string"))), 1, 10).alias("finding_id"))
    return fd.without_suppressed(found, ids).select("l_orderkey", "l_linenumber", "l_partkey", "id", "severity")


@query
def import_audit(spark, sf_dir):
    """Imports written from part rows against a catalogue written from nation rows."""
    sources = dealt(tb.read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"),
        F.expr("concat('import { f', cast(p_partkey % 9 as string), ', g } from \"NATION_', "
               "cast(p_partkey % 31 as string), '\"; import x from \"./local\"; const y = require(\"NATION_', "
               "cast(p_size as string), '\");')").alias("code"),
    )
    catalogue = tb.read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("module"),
        F.explode(F.array(F.lit("g"), F.concat(F.lit("f"), (F.col("n_nationkey") % 9).cast("string")))).alias("export"),
    )
    return fd.unknown_imports(sources, catalogue).select("file", "module", "export", "rule_id", "id")


def _linked_sources(spark, sf_dir):
    """Files with all forms of imports, written from part rows, and the catalogue of their modules from nation rows."""
    sources = dealt(tb.read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        F.concat(F.lit("q"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.expr(tb.linked_source("spark")).alias("code"),
    )
    catalogue = tb.read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("module"),
        F.explode(F.array(F.lit("g"), F.concat(F.lit("f"), (F.col("n_nationkey") % 9).cast("string")))).alias("export"),
    )
    return sources, catalogue


@query
def import_bindings(spark, sf_dir):
    return fd.bindings(_linked_sources(spark, sf_dir)[0])


@query
def unknown_bound_calls(spark, sf_dir):
    return fd.unknown_bound_calls(*_linked_sources(spark, sf_dir))


@query
def unknown_member_calls(spark, sf_dir):
    """Member calls of the units against a catalogue written from nation rows."""
    catalogue = tb.read(spark, sf_dir, "nation").select(
        F.expr("case n_nationkey % 3 when 0 then 'axios' when 1 then 'fs' else 'res' end").alias("module"),
        F.expr("case n_nationkey % 4 when 0 then 'get' when 1 then 'readFile' when 2 then 'status' else 'post' end").alias("export"),
    )
    return fd.unknown_members(units(spark, sf_dir), catalogue)


# --- report --------------------------------------------------------------------------------------


@query
def report_summary(spark, sf_dir):
    return rp.report_summary(scored(spark, sf_dir))


@query
def report_summary_external(spark, sf_dir):
    """With scanner findings, some of them in files no unit is in."""
    return rp.report_summary(scored(spark, sf_dir), external=tb.derived_findings(spark, sf_dir))


@query
def weighted_contributions(spark, sf_dir):
    return rp.weighted_contributions(scored(spark, sf_dir))


@query
def severity_share(spark, sf_dir):
    return rp.severity_shares(tb.derived_findings(spark, sf_dir))


@query
def critical_per_file(spark, sf_dir):
    return rp.critical_per_file(tb.derived_findings(spark, sf_dir))


@query
def report_rows(spark, sf_dir):
    # three reports read the scored units, so they are stored once
    table = cut_lineage(scored(spark, sf_dir).select(
        "path", "code", "loc", "points", "score", "flagged", "band", *sg.SIGNAL_COLUMNS
    ))
    now, old = _delta_sides(spark, sf_dir)
    return rp.report_rows(
        rp.report_summary(table), rp.weighted_contributions(table), dl.delta_summary(now, old)
    )


@query
def first_findings(spark, sf_dir):
    limit = rp.parse_max_findings("50")
    found = tb.derived_findings(spark, sf_dir).select("file", "line", "id", "l_orderkey")
    return rp.first_findings(found, limit, "file", "line", "id", "l_orderkey")


# --- attribution -----------------------------------------------------------------------------------


def _turn_units(spark, sf_dir) -> DataFrame:
    """Conversations as files and turns as units; their line ranges overlap."""
    return tb.read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("path"),
        F.col("turn").cast("int").alias("ordinal"),
        (F.col("turn") * 8 + 1).cast("int").alias("start_line"),
        (F.col("turn") * 8 + 20 + F.length("text") % 30).cast("int").alias("end_line"),
        (F.length("text") % 101).cast("int").alias("score"),
    )


def _turn_findings(spark, sf_dir) -> DataFrame:
    return tb.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("conv"), (F.col("l_orderkey") % 120).cast("string")).alias("file"),
        (F.col("l_quantity") * 2).cast("int").alias("line"),
    )


@query
def attribute_findings(spark, sf_dir):
    placed = at.attribute(_turn_findings(spark, sf_dir), _turn_units(spark, sf_dir), payload=("score",))
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "file", "line", "unit_ordinal", "ai_score")


@query
def files_seen(spark, sf_dir):
    return at.all_files(_turn_units(spark, sf_dir), _turn_findings(spark, sf_dir))


@query
def changed_units(spark, sf_dir):
    changes = tb.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("conv"), (F.col("l_orderkey") % 120).cast("string")).alias("path"),
        (F.col("l_quantity") * 3).cast("int").alias("first_line"),
        (F.col("l_quantity") * 3 + F.col("l_linenumber") - 3).cast("int").alias("last_line"),
    )
    return at.changed_units(_turn_units(spark, sf_dir), changes).select("path", "ordinal", "start_line", "end_line")


@query
def changed_files(spark, sf_dir):
    changed = tb.read(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(
        F.concat(F.lit("conv"), (F.col("l_partkey") % 120).cast("string")).alias("path")
    )
    return at.in_changed_files(_turn_units(spark, sf_dir), changed).select("path", "ordinal")


# --- delta ----------------------------------------------------------------------------------------------


def _delta_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = tb.derived_findings(spark, sf_dir).withColumn("folder", sx.folder_of(F.col("file")))
    return found.filter("current"), found.filter("NOT current")


@query
def delta_new(spark, sf_dir):
    now, old = _delta_sides(spark, sf_dir)
    return dl.new_findings(now, old).select("l_orderkey", "l_linenumber", "id", "severity")


@query
def delta_resolved(spark, sf_dir):
    now, old = _delta_sides(spark, sf_dir)
    return dl.resolved_findings(now, old).select("l_orderkey", "l_linenumber", "id", "severity")


@query
def delta_summary(spark, sf_dir):
    return dl.delta_summary(*_delta_sides(spark, sf_dir))


@query
def delta_baseline(spark, sf_dir):
    return dl.delta_summary(_delta_sides(spark, sf_dir)[0], None)


@query
def folder_changes(spark, sf_dir):
    return dl.folder_changes(*_delta_sides(spark, sf_dir)).drop("in_current")


@query
def folder_movement(spark, sf_dir):
    return dl.folder_movement(*_delta_sides(spark, sf_dir))


def _event_snapshots(spark, sf_dir) -> DataFrame:
    """Every day of a user is a scan; the event type and the payload name a finding."""
    key = F.get_json_object("props", "$.k").cast("int") % 5
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("target_key"),
        F.to_date("ts").alias("scan_ts"),
        sx.digest(10, F.col("event_type"), key).alias("id"),
        F.expr("case event_type when 'error' then 'CRITICAL' when 'purchase' then 'HIGH' "
               "when 'signup' then 'MEDIUM' else 'LOW' end").alias("severity"),
        "event_type",
    )


@query
def delta_series(spark, sf_dir):
    every = _event_snapshots(spark, sf_dir)
    scans = every.select("target_key", "scan_ts").distinct()
    # views are scans without a finding of their own
    found = every.filter("event_type <> 'view'")
    series = dl.delta_series(found, scans)
    return series.withColumn("scan_ts", F.date_format("scan_ts", "yyyy-MM-dd"))


# --- calibration ----------------------------------------------------------------------------------------


def _samples(spark, sf_dir) -> DataFrame:
    """Labelled documents; each line that is not blank is a unit, the document is the file."""
    labels = tb.read(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "ai").otherwise("human").alias("label")
    )
    parts = (
        spread(tb.read(spark, sf_dir, "documents").select("doc_id", "text")).join(labels, "doc_id")
        .select("doc_id", "label", F.explode_outer(F.split("text", "\n")).alias("code"), F.lit("").alias("prefix"))
        .filter(F.col("code").rlike(rf"[^{fixed.WS}]"))
    )
    return cal.sample_scores(sc.score_units(parts), ("doc_id", "label"))


@query
def calibration_samples(spark, sf_dir):
    return _samples(spark, sf_dir)


@query
def calibration_counts(spark, sf_dir):
    return cal.corpus_counts(_samples(spark, sf_dir))


@query
def calibration_sweep(spark, sf_dir):
    return cal.sweep(_samples(spark, sf_dir))


@query
def calibration_best(spark, sf_dir):
    return cal.best_threshold(cal.sweep(_samples(spark, sf_dir)))


@query
def detection_quality(spark, sf_dir):
    return cal.detection_quality(_samples(spark, sf_dir), 20)


# --- normalisers ------------------------------------------------------------------------------------------


def _raw(spark, sf_dir, table: str, key: str, template: str) -> DataFrame:
    return tb.read(spark, sf_dir, table).select(
        F.col(key).alias("scan"), F.expr(rawjson.text(template, "spark")).alias("raw")
    )


@query
def norm_semgrep(spark, sf_dir):
    return nz.semgrep(_raw(spark, sf_dir, "part", "p_partkey", rawjson.SEMGREP), ROOT, ["scan"])


@query
def norm_eslint(spark, sf_dir):
    return nz.eslint(_raw(spark, sf_dir, "part", "p_partkey", rawjson.ESLINT), ROOT, ["scan"])


@query
def eslint_selected(spark, sf_dir):
    rules = ["security/detect-object-injection", "no-eval"]
    raw = _raw(spark, sf_dir, "part", "p_partkey", rawjson.ESLINT)
    return nz.eslint(raw, ROOT, ["scan"], rules=rules).select("scan", "id", "rule_id")


@query
def norm_npm_legacy(spark, sf_dir):
    return nz.npm_audit(_raw(spark, sf_dir, "part", "p_partkey", rawjson.NPM_LEGACY), ROOT, ["scan"], None)


@query
def norm_npm_modern(spark, sf_dir):
    return nz.npm_audit(_raw(spark, sf_dir, "part", "p_partkey", rawjson.NPM_MODERN), ROOT, ["scan"], None)


@query
def npm_threshold(spark, sf_dir):
    raw = _raw(spark, sf_dir, "part", "p_partkey", rawjson.NPM_LEGACY)
    moderate = nz.npm_audit(raw, ROOT, ["scan"], "MODERATE").select("scan", "id", F.lit("moderate").alias("threshold"))
    unknown = nz.npm_audit(raw, ROOT, ["scan"], "whatever").select("scan", "id", F.lit("unknown").alias("threshold"))
    return moderate.unionByName(unknown)


@query
def norm_nodejsscan(spark, sf_dir):
    return nz.nodejsscan(_raw(spark, sf_dir, "supplier", "s_suppkey", rawjson.NODEJSSCAN), ROOT, ["scan"])


@query
def norm_bearer(spark, sf_dir):
    return nz.bearer(_raw(spark, sf_dir, "supplier", "s_suppkey", rawjson.BEARER), ROOT, ["scan"])


@query
def registry_run(spark, sf_dir):
    """All scanners through the registry into the common schema, counted."""
    from inkprint.operators.registry import default_registry

    inputs = {
        "semgrep": _raw(spark, sf_dir, "part", "p_partkey", rawjson.SEMGREP),
        "eslint": _raw(spark, sf_dir, "part", "p_partkey", rawjson.ESLINT),
        "npmAudit": _raw(spark, sf_dir, "part", "p_partkey", rawjson.NPM_MODERN),
        "nodejsscan": _raw(spark, sf_dir, "supplier", "s_suppkey", rawjson.NODEJSSCAN),
        "bearer": _raw(spark, sf_dir, "supplier", "s_suppkey", rawjson.BEARER),
    }
    config = merge_config(scanners={"nodejsscan": {"enabled": False}})
    found = default_registry().run_enabled(inputs, ROOT, config)
    return found.groupBy("source", "severity", "ai_score").agg(F.count("*").alias("findings"))


@query
def registry_isolated(spark, sf_dir):
    """Each scanner on its own: what came of it, with its findings counted; one has no input, one is switched off."""
    from inkprint.operators.registry import default_registry

    inputs = {
        "semgrep": _raw(spark, sf_dir, "part", "p_partkey", rawjson.SEMGREP),
        "eslint": _raw(spark, sf_dir, "part", "p_partkey", rawjson.ESLINT),
        "npmAudit": _raw(spark, sf_dir, "part", "p_partkey", rawjson.NPM_MODERN),
    }
    config = merge_config(scanners={"nodejsscan": {"enabled": False}})
    found, status = default_registry().run_isolated(spark, inputs, ROOT, config, work_folder(spark, "scanners"))
    source = F.coalesce(*(F.when(F.col("name") == name, tag) for name, tag in fixed.SCANNER_SOURCES.items()))
    counted = found.groupBy("source").agg(F.count("*").alias("findings"))
    return status.withColumn("source", source).join(counted, "source", "left").select(
        "name", "status", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings")
    )


@query
def phase_rows(spark, sf_dir):
    """The rows that each phase of a whole scan has written; its milliseconds differ from run to run."""
    from inkprint.plans.scan import run_scan

    found = units(spark, sf_dir)
    scan = run_scan(spark, found.select("path").distinct(), units=found)
    return scan.profile().filter("rows IS NOT NULL").select("phase", "rows")


# --- paths and URLs ---------------------------------------------------------------------------------------


def _path_rows(spark, sf_dir) -> DataFrame:
    return tb.read(spark, sf_dir, "part").select(
        "p_partkey", F.expr(PATH_SQL.format(s="string")).alias("path"),
        F.expr("case when p_partkey % 17 = 0 then null else p_partkey * 1000 end").alias("length"),
    )


PATH_SQL = (
    "concat(case p_partkey % 9 when 0 then 'src/' when 1 then 'node_modules/a/' when 2 then 'core/test/' when 3 then '.next/' "
    "when 4 then 'lib/gen/api/' when 5 then '' when 6 then 'tmp/x/' when 7 then 'app/.hidden/' else 'pkg/dist/' end, "
    "'f', cast(p_partkey as {s}), case p_partkey % 8 when 0 then '.ts' when 1 then '.tsx' when 2 then '.js' when 3 then '.mjs' "
    "when 4 then '.cjs' when 5 then '.md' when 6 then '.jsx' else '.mts' end)"
)


@query
def path_filter(spark, sf_dir):
    path = F.col("path")
    return _path_rows(spark, sf_dir).select(
        "p_partkey", "path",
        pt.ends_like_source(path).alias("cli_source"),
        pt.has_source_extension(path).alias("web_source"),
        pt.has_source_extension(path, fixed.CALIBRATION_EXTENSIONS).alias("calibration_source"),
        pt.in_ignored_dir(path).alias("cli_ignored"),
        pt.has_ignored_segment(path).alias("web_ignored"),
        pt.has_dot_segment(path).alias("dotted"),
        pt.is_excluded(path, ("./test/", "gen/api", "/src")).alias("excluded"),
        pt.file_status(F.col("length")).alias("status"),
        sx.folder_of(path).alias("folder"),
    )


@query
def file_status_counts(spark, sf_dir):
    rows = pt.with_status(pt.source_files(_path_rows(spark, sf_dir)))
    return rows.groupBy("status").agg(F.count("*").alias("files"))


@query
def url_audit(spark, sf_dir):
    pages = tb.read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.audit_urls(pages).select("page_id", "error", "canonical", "host")


@query
def repo_name(spark, sf_dir):
    name = urls.repo_name(F.col("url"))
    at_ms = F.lit(1_700_000_000_000) + F.col("page_id") * 7919
    return tb.read(spark, sf_dir, "pages").select(
        "page_id", name.alias("name"), urls.scan_id(name, at_ms).alias("scan_id")
    )


@query
def slugs(spark, sf_dir):
    name = F.col("p_name")
    return tb.read(spark, sf_dir, "part").select(
        "p_partkey", sx.slug(F.concat_ws("  ", F.col("p_type"), name)).alias("slug"),
        sx.default_if_blank(F.when(F.col("p_size") > 25, F.lit("")).otherwise(name), "none").alias("falsy"),
        sx.default_if_null(F.when(F.col("p_size") > 25, F.lit("")).otherwise(name), "none").alias("nullish"),
        sx.shorten_left(name, 6).alias("short"), sx.signed(F.col("p_size") - 25).alias("signed"),
    )


@query
def key_audit(spark, sf_dir):
    mail = F.expr("case c_custkey % 4 when 0 then concat(lower(c_mktsegment), '@example.com') "
                  "when 1 then c_name when 2 then concat(c_name, '@host') else 'a b@c.d' end")
    return tb.read(spark, sf_dir, "customer").select(
        "c_custkey", sx.token_hash(F.col("c_name")).alias("token_hash"), sx.looks_like_email(mail).alias("email_ok")
    )


# --- history, retention, accounts -----------------------------------------------------------------------


def _scans(spark, sf_dir) -> DataFrame:
    """Purchases as finished scans."""
    return events(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("scan_id"), F.col("ts").alias("created_at"),
        F.floor("value").cast("bigint").alias("flagged_units"),
        (F.col("event_id") % 4).alias("critical"), (F.col("event_id") % 9).alias("high"), "user_id",
    )


def _scan_findings(spark, sf_dir) -> DataFrame:
    return tb.derived_findings(spark, sf_dir).select(
        (F.col("l_orderkey") % 10000).cast("string").alias("scan_id"), "id", "severity"
    )


@query
def scan_retention(spark, sf_dir):
    kept = hs.kept_scans(_scans(spark, sf_dir))
    return hs.findings_of(_scan_findings(spark, sf_dir), kept).groupBy("scan_id").agg(F.count("*").alias("findings"))


@query
def kept_scans(spark, sf_dir):
    return hs.kept_scans(_scans(spark, sf_dir)).select("scan_id", "flagged_units")


@query
def latest_findings(spark, sf_dir):
    return hs.latest_findings(_latest_scans(spark, sf_dir), _scan_findings(spark, sf_dir))


def _latest_scans(spark, sf_dir) -> DataFrame:
    return _scans(spark, sf_dir)


@query
def scan_added(spark, sf_dir):
    """The store with one more scan than there was before: the newest scan is added to the others."""
    scans, found = _scans(spark, sf_dir), _scan_findings(spark, sf_dir)
    newest = F.col("scan_id") == scans.agg(F.max_by("scan_id", F.struct("created_at", "scan_id"))).scalar()
    kept, theirs = hs.add_scan(scans.filter(~newest), found.filter(~newest), scans.filter(newest), found.filter(newest))
    counted = theirs.groupBy("scan_id").agg(F.count("*").alias("findings"))
    return kept.select("scan_id").join(counted, "scan_id", "left").select("scan_id", F.coalesce("findings", F.lit(0)).alias("findings"))


@query
def api_findings(spark, sf_dir):
    found = fd.local_findings(sc.score_units(units(spark, sf_dir)).withColumns({
        "id": un.unit_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name")), "explained": sc.explained(), "signals": sc.signal_array(merge_config()),
    }))
    listed = hs.api_findings(found.select(*fd.FINDING_COLUMNS))
    return listed.groupBy("source", "severity").agg(
        F.count("*").alias("findings"), F.max(F.size("top_signals")).alias("most_signals"), F.sum("ai_score").alias("ai_scores")
    )


@query
def report_documents(spark, sf_dir):
    found = tb.derived_findings(spark, sf_dir).select("file", "line", "id", "severity")
    own = units(spark, sf_dir).select("path", "ordinal", "start_line", F.col("name").alias("id"))
    documents = ts.report_documents(own, found)
    part = lambda name: F.json_array_length(F.get_json_object("report", f"$.{name}")).cast("bigint")
    return documents.select("path", part("units").alias("units"), part("findings").alias("findings"), F.get_json_object("report", "$.findings[0].id").alias("first_id"))


@query
def findings_written(spark, sf_dir):
    """Findings as JSON lines, written to the shared folder and read back."""
    found, place = tb.derived_findings(spark, sf_dir).select("id", "severity", "file", "line"), work_folder(spark, "findings")
    ts.write_findings(found, place)
    return spark.read.schema(found.schema).json(place).groupBy("severity").agg(F.count("*").alias("findings"), F.sum("line").alias("lines"), F.min("id").alias("first_id"))


@query
def snapshot_replaced(spark, sf_dir):
    """The stored snapshot of a target after a second one has taken the place of the first."""
    store = ts.SnapshotStore(spark, work_folder(spark, "snapshots"))
    now, old = _delta_sides(spark, sf_dir)
    for at, rows in (("2024-01-01", old), ("2024-01-02", now)):
        stamp = F.to_timestamp(F.lit(at))
        store.replace(rows.select(F.lit("t").alias("target_key"), stamp.alias("scan_ts"), "id", "severity", "folder"), "t", stamp)
    return store.previous("t").groupBy("severity").agg(F.count("*").alias("findings"), F.date_format(F.max("scan_ts"), "yyyy-MM-dd").alias("scanned"))


@query
def calibration_written(spark, sf_dir):
    """The sweep as it is written and read back."""
    samples, place = cut_lineage(_samples(spark, sf_dir)), work_folder(spark, "calibration")
    swept = cal.sweep(samples)
    ts.write_calibration(swept, cal.corpus_counts(samples), cal.best_threshold(swept), place)
    return spark.read.schema(swept.schema).json(f"{place}/evaluations")


@query
def findings_summary(spark, sf_dir):
    return rp.severity_counts(hs.latest_findings(_latest_scans(spark, sf_dir), _scan_findings(spark, sf_dir)))


@query
def dashboard_totals(spark, sf_dir):
    return rp.dashboard_totals(_scans(spark, sf_dir))


@query
def scan_rows(spark, sf_dir):
    counts = tb.derived_findings(spark, sf_dir).groupBy((F.col("l_orderkey") % 500).alias("scan")).agg(
        F.countDistinct("file").alias("files_scanned"), F.count("*").alias("total_units"),
        F.count_if("current").alias("flagged_units"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in fixed.SEVERITIES],
    )
    rows = counts.withColumn("ai_percentage", sx.half_up(F.col("flagged_units") / F.col("total_units") * 100))
    made = hs.scan_rows(rows, failed=F.col("scan") % 10 == 0)
    at_ms = F.lit(1_700_000_000_000) + F.col("scan") * 1000
    return made.withColumn("scan_id", urls.scan_id(F.concat(F.lit("Repo."), F.col("scan").cast("string")), at_ms))


def _history_lines(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.expr(HISTORY_SQL.format(s="string")).alias("line"))


HISTORY_SQL = (
    "case when event_id % 7 = 3 then '{{broken' when event_id % 11 = 5 then '  ' else concat("
    "'{{\"timestamp\":\"2024-01-02T0', cast(event_id % 10 as {s}), ':15:00Z\",\"mode\":\"', "
    "case when event_id % 2 = 0 then 'scan' else 'check' end, '\",\"target\":\"u', cast(user_id as {s}), "
    "'\",\"blocked\":', case when event_type = 'error' then 'true' else 'false' end, "
    "',\"filesScanned\":', cast(event_id % 50 as {s}), ',\"aiScore\":', cast(event_id % 90 as {s}), '.5}}') end"
)


@query
def history_recent(spark, sf_dir):
    return hs.recent_history(_history_lines(spark, sf_dir), 40)


@query
def history_retained(spark, sf_dir):
    return hs.retained_history(_history_lines(spark, sf_dir))


@query
def history_lines(spark, sf_dir):
    recent = hs.recent_history(_history_lines(spark, sf_dir), 300)
    label = sx.history_label(
        F.col("mode"), F.to_timestamp("timestamp"), F.col("blocked"), F.col("aiScore")
    )
    return recent.select("seq", label.alias("label"))


@query
def history_text(spark, sf_dir):
    """The labels of the last lines in one text."""
    return hs.history_line(history_lines(spark, sf_dir))


@query
def scan_trend(spark, sf_dir):
    history = events(spark, sf_dir).select(
        F.col("user_id").alias("target"), "ts", F.col("event_id").alias("seq"),
        sx.half_up(F.col("value")).alias("score"),
    )
    return hs.score_trend(history).drop("ts")


@query
def rate_limit_audit(spark, sf_dir):
    """Ten scans an hour; users share accounts by tens here, so that some go over."""
    log = events(spark, sf_dir).select((F.col("user_id") % 3).alias("user_id"), "event_id", "ts")
    return hs.over_hourly_limit(log, 7).drop("ts")


@query
def scan_status(spark, sf_dir):
    log = events(spark, sf_dir).select(
        F.col("user_id").alias("scan_id"), "ts", F.col("event_id").alias("seq"),
        F.expr("case event_type when 'signup' then 'PENDING' when 'click' then 'RUNNING' "
               "when 'error' then 'FAILED' else 'COMPLETED' end").alias("status"),
    )
    return hs.latest_status(log)


@query
def repo_size_gate(spark, sf_dir):
    files = tb.read(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("n_chars").alias("length"))
    average = files.agg(F.floor(F.avg("length") * 48).alias("limit"))
    return hs.repos_within_limits(files, max_bytes=average.scalar())


@query
def repo_fingerprint(spark, sf_dir):
    figured = sg.figures(documents(spark, sf_dir)).withColumn("complexity", un.complexity(F.col("code")))
    return sc.repo_fingerprint(figured, "source")


@query
def baseline_deviation(spark, sf_dir):
    # read twice, so the few numbers both sides need are stored once
    numbers = cut_lineage(
        sg.figures(documents(spark, sf_dir)).select("doc_id", "source", "ident_entropy", "comment_ratio")
    )
    baseline = numbers.groupBy("source").agg(*sc.style_moments())
    return sc.baseline_deviation(numbers, baseline, "source").select(
        "doc_id", "source", "entropy_deviation", "comment_deviation"
    )


@query
def scanner_notes(spark, sf_dir):
    notes = tb.read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.when(F.col("role") == "user", "warn").otherwise("log").alias("level"),
        F.expr("case turn % 4 when 0 then concat('[scan-core] ', role, ' skipped') "
               "when 1 then concat('[scan-core] \n  \n  note ', role, ' \nmore') "
               "when 2 then '[scan-core] docker: error during connect: x' else substring(text, 1, 12) end").alias("text"),
    )
    return hs.unique_notes(notes.withColumn("text", hs.clean_note(F.col("text"))))


# --- accounts ------------------------------------------------------------------------------------------


@query
def session_validity(spark, sf_dir):
    sessions = events(spark, sf_dir).select(
        "event_id", "user_id",
        F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"),
        (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"),
    )
    users = tb.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    at = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return ac.valid_sessions(sessions, users, at).select("event_id", "user_id", "email")


def _attempts(df: DataFrame) -> DataFrame:
    """Errors are failed logins, signups good ones."""
    return df.filter("event_type IN ('error', 'signup')").select(
        F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "signup").alias("ok"), F.col("event_id").alias("seq"),
    )


@query
def lockout_replay(spark, sf_dir):
    return ac.lockouts(_attempts(tb.read(spark, sf_dir, "events")))


@query
def lockout_replay_shared(spark, sf_dir):
    """Few accounts with many attempts each: long chains, and attempts that fall into locks."""
    attempts = _attempts(tb.read(spark, sf_dir, "events"))
    return ac.lockouts(attempts.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 5)))


@query
def activity_sessions(spark, sf_dir):
    history = events(spark, sf_dir).select(F.col("user_id").alias("target"), "ts")
    return ac.activity_sessions(history, 12 * 3600)


# --- streams -------------------------------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    return sinks.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def progress_fold(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 1000).alias("index"),
        (F.lit(1000) + F.col("event_id") % 3).alias("total"),
        F.expr("case event_type when 'click' then 'scanned' when 'purchase' then 'skipped' "
               "when 'error' then 'missing' when 'signup' then 'scanned' else 'scanning' end").alias("status"),
        (F.col("event_id") % 4).alias("findings"),
    )
    return sinks.final_state(jobs.progress_fold(stream), "progress", ["scan_id"])


@query
def stream_score(spark, sf_dir):
    stream = sinks.source(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"), F.lit("").alias("prefix"))
    return sinks.append_all(
        jobs.scored_stream(stream).select("doc_id", "points", "score", "flagged", "band"), "stream-score"
    )


def _finding_stream(spark, sf_dir) -> DataFrame:
    return _event_stream(spark, sf_dir).select(
        "ts",
        sx.digest(10, F.col("event_type"), F.get_json_object("props", "$.k")).alias("id"),
        (F.col("event_id") % 3).alias("match_no"),
        F.expr("case event_type when 'error' then 'CRITICAL' when 'purchase' then 'HIGH' "
               "when 'signup' then 'MEDIUM' else 'LOW' end").alias("severity"),
    )


@query
def stream_finding_rate(spark, sf_dir):
    rate = jobs.finding_rate(_finding_stream(spark, sf_dir), "1 hour", "6 hours", "3 hours")
    last = sinks.final_state(rate, "rate", ["start", "end", "severity"])
    return last.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "severity", "findings")


@query
def stream_dedupe(spark, sf_dir):
    once = jobs.unique_findings(_finding_stream(spark, sf_dir), "60 days")
    return sinks.append_all(once, "dedupe").select("id", "match_no")


def _last_event(spark, sf_dir):
    return tb.read(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]


@query
def stream_sessions(spark, sf_dir):
    """All sessions, those still open when the stream ends too."""
    history = _event_stream(spark, sf_dir).select(F.col("user_id").alias("target"), "ts")
    build = lambda events: jobs.target_sessions(events, "1 hour", "12 hours")
    made = sinks.append_to_the_end(history, build, "sessions", _last_event(spark, sf_dir), "14 hours")
    return made.select("target", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "scans")


@query
def stream_delta(spark, sf_dir):
    found = sinks.source(spark, sf_dir, "lineitem").select(
        *[F.expr(sql).alias(name) for name, sql in tb.finding_columns("spark").items()]
    )
    return jobs.delta_on_arrival(found.filter("current"), _delta_sides(spark, sf_dir)[1], "delta")


SCAN_BLOCKS = 3


@query
def stream_scan_deltas(spark, sf_dir):
    """Every scan of the days of users, told when it is whole: a day's findings come in two of four steps, its end in the second."""
    every = _event_snapshots(spark, sf_dir).withColumns({"scan_ts": F.col("scan_ts").cast("timestamp"), "folder": F.lit("")})
    day = F.unix_date(F.col("scan_ts").cast("date"))
    ends = every.agg(F.min(day).alias("low"), F.max(day).alias("high")).first()
    step = F.lit(0) if ends["low"] is None else F.floor((day - ends["low"]) * SCAN_BLOCKS / (ends["high"] - ends["low"] + 1))
    found = every.filter("event_type <> 'view'").select(
        "target_key", "scan_ts", "id", "severity", "folder", F.lit(None).cast("bigint").alias("expected"),
        (step + F.pmod(F.xxhash64("id"), F.lit(2))).alias("step"),
    )
    nothing = F.lit(None).cast("string")
    closing = every.groupBy("target_key", "scan_ts").agg(F.count_if(F.col("event_type") != "view").alias("expected")).select(
        "target_key", "scan_ts", nothing.alias("id"), nothing.alias("severity"), nothing.alias("folder"), "expected", (step + 1).alias("step")
    )
    place = work_folder(spark, "scan-deltas")
    found.unionByName(closing).write.partitionBy("step").parquet(f"{place}/arriving")
    arriving = spark.read.schema(jobs.ARRIVING + ", step int").parquet(f"{place}/arriving")
    arriving.limit(0).drop("step").write.parquet(f"{place}/in")
    store = ts.SnapshotStore(spark, f"{place}/store", buckets=8)
    for number in range(SCAN_BLOCKS + 1):
        arriving.filter(F.col("step") == number).drop("step").write.mode("append").parquet(f"{place}/in")
        deltas = jobs.delta_per_scan(spark.readStream.schema(jobs.ARRIVING).parquet(f"{place}/in"), store, f"{place}/run")
    return deltas.withColumn("scan_ts", F.date_format("scan_ts", "yyyy-MM-dd"))


@query
def snapshots_of_many_targets(spark, sf_dir):
    """The last day of every user in a store of eight buckets, written a day before as well, then compacted."""
    every = _event_snapshots(spark, sf_dir).withColumns({"scan_ts": F.col("scan_ts").cast("timestamp"), "folder": F.lit("")})
    store = ts.SnapshotStore(spark, work_folder(spark, "snapshots"), buckets=8)
    scans = every.groupBy("target_key").agg(F.sort_array(F.collect_set("scan_ts"), asc=False).alias("days"))
    for place in (1, 0, 0):
        chosen = scans.select("target_key", F.get("days", place).alias("scan_ts")).filter("scan_ts IS NOT NULL")
        store.replace_all(every.join(chosen, ["target_key", "scan_ts"], "left_semi"), chosen)
    store.compact()
    return store.read().groupBy("target_key").agg(
        F.date_format(F.max("scan_ts"), "yyyy-MM-dd").alias("scanned"), F.count("*").alias("findings"), F.min("id").alias("first_id")
    )


@query
def stream_lockouts(spark, sf_dir):
    """All locks, those of the last hour too."""
    attempts = _attempts(_event_stream(spark, sf_dir))
    return sinks.append_to_the_end(attempts, lock_events, "lockouts", _last_event(spark, sf_dir), "2 hours")


QUERIES["stream_sessions_to_the_end"] = stream_sessions
QUERIES["stream_lockouts_to_the_end"] = stream_lockouts
