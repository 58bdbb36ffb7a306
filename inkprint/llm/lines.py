"""Line deduplication by content-defined chunks of lines, with DataFrame functions only.

A rolling hash runs over the hashes of each line and its successor; a chunk begins where it has a
local minimum, so borders depend on the lines around them and survive lines added or removed
elsewhere, and every chunk but a text's first has two lines at least. Of equal chunks with two
lines or more, compared byte by byte, the first one stays.

Local minima cannot lie on the edges of a passage, nor in one of few lines. So every line with words
also begins one chunk and ends another, of the fewest lines with over 50 words: a repeated run of lines
with more words than that, be it a single line, consists of such chunks wherever it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.rows import explode_once
from inkprint.llm.common import WORD, bind, lookup, stored

PASSAGE_WORDS = 50  # a passage has more words than these


def _chunks(text: Column) -> Column:
    """An array of (no, start, lines, body); ``body`` is null where a chunk is not up for removal."""

    def rolled(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.md5(F.concat(h, F.coalesce(F.get(hashes, i + 1), F.lit("")))))

    def starts(roll: Column) -> Column:
        low = lambda i: (F.get(roll, i) < F.get(roll, i - 1)) & (F.get(roll, i) <= F.get(roll, i + 1))
        places = F.transform(roll, lambda _, i: i)
        return F.concat(F.array(F.lit(0)), F.filter(places, lambda i: (i > 0) & (i < F.size(roll) - 1) & low(i)))

    def cut(lines: Column, begun: Column) -> Column:
        def chunk(start: Column, no: Column) -> Column:
            part = F.slice(lines, start + 1, F.coalesce(F.get(begun, no + 1), F.size(lines)) - start)
            return bind(part, lambda p: bind(F.array_join(p, "\n"), lambda body: F.struct(
                no.alias("no"), start.alias("start"), p.alias("lines"), F.when((F.size(p) > 1) & body.rlike(r"[^\x20\x09-\x0D]"), body).alias("body")
            )))

        return F.transform(begun, chunk)

    return bind(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda lines: bind(
        F.transform(lines, lambda line: F.md5(line)), lambda hashes: bind(rolled(hashes), lambda roll: bind(starts(roll), lambda begun: cut(lines, begun)))
    ))


def _windows(text: Column) -> Column:
    """An array of (start, stop, hash): the fewest lines with over 50 words from every line, and up to every line."""

    def window(part: Column, back: bool) -> Column:
        add = lambda a, y: F.when(a["n"] > PASSAGE_WORDS, a).otherwise(F.struct((a["n"] + y["n"]).alias("n"), (a["m"] + 1).alias("m")))
        order = F.reverse if back else lambda p: p
        return bind(F.aggregate(part, F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")), add), lambda a: F.when(
            a["n"] > PASSAGE_WORDS, bind(order(F.slice(part, 1, a["m"])), lambda p: F.struct(
                F.get(p, 0)["i"].alias("start"), F.get(p, a["m"] - 1)["i"].alias("stop"),
                F.substring(F.unhex(F.sha2(F.array_join(F.transform(p, lambda y: y["line"]), "\n"), 256)), 1, 16).alias("hash"),
            ))
        ))

    counted = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line, i: F.struct(
        i.alias("i"), line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("n")
    ))
    most = PASSAGE_WORDS + 1  # lines of a window, as each has a word
    return bind(F.filter(counted, lambda y: y["n"] > 0), lambda said: bind(F.reverse(said), lambda turned: F.array_distinct(F.filter(
        F.concat(
            F.transform(said, lambda _, k: window(F.slice(said, k + 1, most), False)),
            F.transform(turned, lambda _, k: window(F.slice(turned, k + 1, most), True)),
        ), lambda w: w.isNotNull()
    ))))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_lines, n_removed, and the columns ``keep``.

    Order is that of the ids (null first), then of the place in the text: the first of equal chunks
    stays. Null texts stay null and count one empty line, as empty texts do. Chunks without words stay;
    blank lines between the lines of a passage do not count in a comparison and go with it; where no
    line with words is left, no line is left. A line in a passage that comes first stays, unless a chunk
    by minima takes it, which then stands earlier. Repeated rows are one document: what stays in one
    stays in all of them. Other columns are left out, whatever their names, as are names in ``keep`` that
    the result has itself.
    """
    return _remove(docs, doc_id, text, keep, minima=True)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``dedup`` by the chunks of over 50 words alone: every repeated run of lines with more words goes but the first."""
    return _remove(docs, doc_id, text, keep, minima=False)


def _remove(docs: DataFrame, doc_id: str, text: str, keep: Sequence[str], minima: bool) -> DataFrame:
    keep = [k for k in keep if k not in ("doc_id", "text", "n_lines", "n_removed")]
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(k).alias(f"_keep{i}") for i, k in enumerate(keep))
    ).withColumn("_row", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))))
    chunks = explode_once(rows, "doc_id", "_row", items=_chunks(F.col("text")), name="c")
    # equal bytes meet in one group; copies combine before the shuffle
    owners = (
        chunks.select("doc_id", "_row", "c.no", "c.body").filter("body IS NOT NULL")
        .groupBy(F.xxhash64("body").alias("hash"), "body").agg(F.min(F.struct("doc_id", "_row", "no")).alias("first"))
        .groupBy(F.col("first._row").alias("_row")).agg(F.collect_set("first.no").alias("_owned"))
    )
    windows = stored(explode_once(rows, "doc_id", "_row", items=_windows(F.col("text")), name="w").select("doc_id", "_row", "w.*"), "windows")
    place = F.struct("doc_id", "_row", "start", "stop")
    repeated = stored(
        windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        .filter("first != last").drop("last"), "repeated",
    )
    found = lookup(windows, repeated, "hash", "n", windows.count(), how="inner")
    is_first = (F.col("_row") == F.col("first._row")) & (F.col("start") == F.col("first.start"))
    marks = found.groupBy("_row").agg(F.collect_set(F.struct("start", "stop", is_first.alias("first"))).alias("_marks"))
    lines_of = lambda spans: F.array_distinct(F.flatten(F.transform(spans, lambda w: F.sequence(w["start"], w["stop"]))))
    marked = F.coalesce("_marks", F.array().cast("array<struct<start:int,stop:int,first:boolean>>"))
    in_passages = F.array_except(lines_of(F.filter(marked, lambda w: ~w["first"])), lines_of(F.filter(marked, lambda w: w["first"])))
    goes = lambda c: c["body"].isNotNull() & ~F.coalesce(F.array_contains("_owned", c["no"]), F.lit(False))
    in_chunks = bind(_chunks(F.col("text")), lambda all_of: F.flatten(F.transform(
        F.filter(all_of, goes), lambda c: F.sequence(c["start"], c["start"] + F.size(c["lines"]) - 1)
    )))

    gone_at = F.concat(in_chunks, in_passages) if minima else in_passages

    def left(lines: Column, gone: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return bind(F.transform(stay, lambda i: F.get(lines, i)), lambda kept: bind(
            (F.size(gone) == 0) | F.exists(kept, lambda line: line.rlike(WORD)), lambda some: F.struct(
                F.when(some, F.array_join(kept, "\n")).otherwise("").alias("text"), F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.when(some, F.size(kept)).otherwise(0)).cast("long").alias("n_removed"),
            )
        ))

    out = bind(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda lines: bind(gone_at, lambda gone: left(lines, gone)))
    kept = [F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)]
    known = rows.join(owners, "_row", "left") if minima else rows
    joined = known.join(marks, "_row", "left").select("doc_id", F.col("text").isNull().alias("_null"), out.alias("_out"), *kept)
    return joined.select("doc_id", F.when(~F.col("_null"), F.col("_out.text")).alias("text"), "_out.n_lines", "_out.n_removed", *keep)


SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l,
         md5(concat(coalesce(CAST(doc_id AS varchar), ''), chr(10), coalesce(text, ''))) AS own FROM documents
), hashed AS (SELECT *, list_transform(l, lambda x: md5(x)) AS h FROM lines),
rolled AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: md5(concat(h[i], coalesce(h[i + 1], '')))) AS r FROM hashed),
begun AS (
  SELECT *, list_concat([1], list_filter(range(2, len(l)), lambda i: r[i] < r[i - 1] AND r[i] <= r[i + 1])) AS b FROM rolled
), chunks AS (
  SELECT doc_id, own, no, b[no] AS s, coalesce(b[no + 1], len(l) + 1) - 1 AS e, list_slice(l, b[no], coalesce(b[no + 1], len(l) + 1) - 1) AS part
  FROM (SELECT *, unnest(range(1, len(b) + 1)) AS no FROM begun)
), bodies AS (SELECT *, array_to_string(part, chr(10)) AS body FROM chunks),
marked AS (
  SELECT *, len(part) > 1 AND regexp_matches(body, '[^\x20\x09-\x0D]') AS up,
         row_number() OVER (PARTITION BY body, len(part) > 1 ORDER BY doc_id NULLS FIRST, own, no) AS place FROM bodies
), each AS (SELECT doc_id, own, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM lines),
said AS (
  SELECT *, row_number() OVER w AS k, sum(n) OVER w AS upto FROM (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM each) WHERE n > 0 WINDOW w AS (PARTITION BY own ORDER BY i)
), near AS (
  SELECT a.own, a.k AS k1, b.k AS k2 FROM said a JOIN said b ON a.own = b.own AND b.k BETWEEN a.k AND a.k + 50 AND b.upto - a.upto + a.n > 50
), spans AS (
  SELECT own, k1, min(k2) AS k2 FROM near GROUP BY own, k1 UNION SELECT own, max(k1) AS k1, k2 FROM near GROUP BY own, k2
), texts AS (
  SELECT s.own, any_value(t.doc_id) AS doc_id, min(t.i) AS s, max(t.i) AS e, string_agg(t.line, chr(10) ORDER BY t.i) AS body
  FROM spans s JOIN said t ON t.own = s.own AND t.k BETWEEN s.k1 AND s.k2 GROUP BY s.own, s.k1, s.k2
), passages AS (
  SELECT *, count(*) OVER (PARTITION BY body) AS n, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, own, s) AS place FROM texts
), gone AS (
  SELECT own, unnest(range(s, e + 1)) AS i FROM marked WHERE up AND place > 1 UNION (
  SELECT own, unnest(range(s, e + 1)) AS i FROM passages WHERE n > 1 AND place > 1 EXCEPT
  SELECT own, unnest(range(s, e + 1)) AS i FROM passages WHERE n > 1 AND place = 1)
), told AS (
  SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_gone, coalesce(string_agg(line, chr(10) ORDER BY each.i) FILTER (g.i IS NULL), '') AS kept,
         count(*) FILTER (g.i IS NULL AND regexp_matches(line, '[^\x20\x09-\x0D]')) > 0 AS worded
  FROM each LEFT JOIN gone g ON g.own = each.own AND g.i = each.i GROUP BY doc_id, each.own
)
SELECT doc_id, CAST(n_lines AS bigint) AS n_lines, CAST(CASE WHEN n_gone = 0 OR worded THEN n_gone ELSE n_lines END AS bigint) AS n_removed,
       sha256(CASE WHEN n_gone = 0 OR worded THEN kept ELSE '' END) AS kept_sha256 FROM told
"""
