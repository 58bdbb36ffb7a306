"""Small numeric, hash and text Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkprint import fixed


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards (-2.5 becomes -2)."""
    return F.floor(x + F.lit(0.5))


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + F.lit(0.5)) / 10


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(as_column(high), x))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def steady(x: Column) -> Column:
    """Nine decimals: enough for every formula, and free of summation-order noise."""
    return F.round(x, 9)


def digest(length: int, *parts: Column | str) -> Column:
    """First ``length`` hex digits of the SHA-1 of the parts joined with colons."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.sha1(F.concat_ws(":", *columns)), 1, length)


def token_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def trim_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(fixed.WS_CHARACTERS))


def default_if_null(x: Column, default: Column | str | int) -> Column:
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(default))


def default_if_blank(x: Column, default: Column | str) -> Column:
    """For null and for the empty text."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def default_if_zero(x: Column, default: int) -> Column:
    """For null and for zero."""
    return F.coalesce(F.nullif(x, F.lit(0)), F.lit(default))


def slug(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, rf"[{fixed.WS}]+", "-"))


def spaced(x: Column) -> Column:
    """Dashes and underscores become blanks."""
    return F.translate(x, "-_", "  ")


def contains_any(x: Column, needles: Sequence[str]) -> Column:
    hit = x.contains(needles[0])
    for needle in needles[1:]:
        hit = hit | x.contains(needle)
    return hit


def first_matching(x: Column, table: Sequence[tuple[str, Sequence[str]]], default: Column) -> Column:
    """The first entry of ``table`` one of whose needles occurs in ``x``."""
    chain = None
    for value, needles in table:
        test = contains_any(x, needles)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(default)


def lookup(x: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A fixed table as a CASE expression: no join for a handful of entries."""
    chain = None
    for key, value in table.items():
        chain = F.when(x == key, F.lit(value)) if chain is None else chain.when(x == key, F.lit(value))
    return chain.otherwise(F.lit(default)) if default is not None else chain


def severity_risk(severity: Column) -> Column:
    return lookup(severity, fixed.SEVERITY_RISK)


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def shorten_left(text: Column, limit: int) -> Column:
    """Keep the right end and mark the cut with an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.lit("\u2026"), F.right(text, F.lit(limit - 1)))
    )


def finite_or_zero(text: Column) -> Column:
    """A number given as text; what is no finite number counts as 0."""
    value = text.try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(usable, value).otherwise(F.lit(0.0))


def looks_like_email(x: Column) -> Column:
    return x.rlike(fixed.EMAIL_SHAPE)


def folder_of(path: Column, root: Column | str = "") -> Column:
    """First folder of a path; absolute paths are taken relative to ``root``."""
    root_column = F.lit(root) if isinstance(root, str) else root
    slashed = F.translate(path, "\\", "/")
    base = F.concat(F.rtrim(root_column, F.lit("/")), F.lit("/"))
    relative = (
        F.when(slashed.startswith(base), F.substr(slashed, F.length(base) + 1))
        .when(slashed.startswith("/") & (root_column != ""), F.lit("../"))  # outside the root
        .otherwise(slashed)
    )
    relative = F.regexp_replace(relative, r"^(?:\./)+", "")
    return F.when(F.instr(relative, "/") > 0, F.substring_index(relative, "/", 1)).otherwise(F.lit("<root>"))


def history_label(mode: Column, at: Column, blocked: Column, score_text: Column) -> Column:
    """``scan 09:30 pass 12``"""
    return F.concat_ws(
        " ",
        mode,
        F.date_format(at, "HH:mm"),
        F.when(blocked, "blocked").otherwise("pass"),
        half_up(finite_or_zero(score_text)).cast("string"),
    )
