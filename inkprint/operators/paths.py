"""File filters as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint import fixed


def segments(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: s != "")


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/")
    if not base:
        return F.regexp_replace(path, "^(?:\\./)+", "")
    return (
        F.when(path == base, "")
        .when(path.startswith(base + "/"), F.substr(path, F.lit(len(base) + 2)))
        .otherwise(F.regexp_replace(path, "^(?:\\./)+", ""))
    )


def ends_like_source(path: Column, extensions: Sequence[str] = fixed.CLI_EXTENSIONS) -> Column:
    """Command-line rule: the path just ends with one of the extensions."""
    return reduce(or_, (path.endswith(e) for e in extensions))


def has_source_extension(path: Column, extensions: Sequence[str] = fixed.WEB_EXTENSIONS) -> Column:
    """Web and calibration rule: the extension proper, which a dot file does not have."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1).isin(*extensions)


def in_ignored_dir(path: Column, ignored: Sequence[str] = fixed.CLI_IGNORED_DIRS) -> Column:
    """A directory segment (not the file name) is in the set."""
    parts = segments(path)
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(i) for i in ignored]))


def has_ignored_segment(path: Column, ignored: Sequence[str] = fixed.WEB_IGNORED_DIRS) -> Column:
    """Any segment, the file name included, is in the set."""
    return F.arrays_overlap(segments(path), F.array(*[F.lit(i) for i in ignored]))


def has_dot_segment(path: Column) -> Column:
    """Calibration rule: a file or directory whose name starts with a dot."""
    return path.rlike(r"(?:^|/)\.(?!\.?(?:/|$))")


def _clean_pattern(pattern: str) -> str:
    bare = pattern.removeprefix("./").replace("\\", "/")
    return bare.strip("/")


def is_excluded(path: Column, patterns: Sequence[str], root: str = "") -> Column:
    """One-segment patterns hit any segment, longer ones a run of whole segments."""
    wanted = [p for p in map(_clean_pattern, patterns) if p]
    if not wanted:
        return F.lit(False)
    relative = F.translate(relative_to(path, root), "\\", "/")
    single = [p for p in wanted if "/" not in p]
    tests = [
        (relative == p) | relative.startswith(p + "/") | relative.contains(f"/{p}/") for p in wanted if "/" in p
    ]
    if single:
        tests.append(F.arrays_overlap(segments(relative), F.array(*[F.lit(p) for p in single])))
    return reduce(or_, tests)


def source_files(files: DataFrame, root: str = "", exclude: Sequence[str] = fixed.DEFAULT_EXCLUDES) -> DataFrame:
    """Command-line selection over a table with a ``path``."""
    path = F.col("path")
    below = relative_to(path, root)
    return files.filter(ends_like_source(path) & ~in_ignored_dir(below) & ~is_excluded(path, exclude, root))


def web_source_files(files: DataFrame, root: str = "") -> DataFrame:
    path = F.col("path")
    return files.filter(has_source_extension(path) & ~has_ignored_segment(relative_to(path, root)))


def calibration_files(files: DataFrame, root: str = "") -> DataFrame:
    path = F.col("path")
    return files.filter(
        has_source_extension(path, fixed.CALIBRATION_EXTENSIONS) & ~has_dot_segment(relative_to(path, root))
    )


def file_status(length: Column, max_size: int = fixed.MAX_FILE_SIZE) -> Column:
    """``missing`` without a length, ``skipped`` above the limit, else ``scanned``."""
    return F.when(length.isNull(), "missing").when(length > max_size, "skipped").otherwise("scanned")


def with_status(files: DataFrame, max_size: int = fixed.MAX_FILE_SIZE) -> DataFrame:
    return files.withColumn("status", file_status(F.col("length"), max_size))
