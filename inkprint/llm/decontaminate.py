"""Benchmark decontamination with SimHash over item-sized windows, with DataFrame functions only.

Windows as long as an item are placed wherever a text holds one of the item's shingles, on the
diagonal of that shingle; a window without any has similarity 0. Windows and items get weighted
SimHash fingerprints. Four blocks of 16 bits are indexed with every value up to four bits away, so
all fingerprints within 19 bits share an entry; the exact weighted similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.rows import explode_once
from inkprint.llm.common import bind, lower_ascii, stored

SHINGLE = 5  # words
SIMILARITY = 80  # per cent, weighted Jaccard
BLOCKS, BLOCK_RADIUS = 4, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1  # a fingerprint this near has a block this near
SMALL_ROWS = 1_000_000  # item shingles that are sent to every task; more are joined by a shuffle
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")


def _hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words at every place; a shorter text has none."""
    n = F.size(words)
    places = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))


def _identity(key: str, text: Column) -> Column:
    """128 bits that tell a row from all others but its repetitions."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))))


def _shingles(words: Column) -> Column:
    """The distinct shingles themselves."""
    n = F.size(words)
    return F.array_distinct(F.when(
        n > SHINGLE, F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    ).otherwise(F.array(F.array_join(words, " "))))


def _weight(shingles: Column) -> Column:
    """A shingle weighs as much as it has characters."""
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, s: a + F.length(s))


def fingerprints(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``print``, the 64-bit weighted SimHash of the distinct shingles in ``shingles``; keys identify a row."""
    each = rows.select(*keys, F.explode("shingles").alias("s")).select(*keys, F.xxhash64("s").alias("h"), F.length("s").cast("long").alias("w"))
    votes = each.groupBy(*keys).agg(*(
        F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"v{b}") for b in range(64)
    ))
    bits = F.lit(0).cast("long")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"v{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, bits.alias("print"))


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The contaminated pairs: doc_id, item_id, start (word, from 0), similarity of the best window.

    A window is as many words as the item has, or the whole text if that is shorter. Texts and
    items without words (null, empty) match nothing; an item with fewer words than a shingle is one
    shingle of its own length, found wherever a text has its words in a row.
    Equal windows tie to the first start. Repeated rows give one pair, as do items that share an id.
    Null ids pass through. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row", _identity("doc_id", F.col("text")))
    known = stored(
        items.select(F.col(item_id).cast("long").alias("item_id"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
        .withColumn("item", _identity("item_id", F.array_join("words", " "))).dropDuplicates(["item"])
        .withColumns({"n": F.size("words"), "shingles": _shingles(F.col("words"))}), "items",
    )
    spots = stored(
        explode_once(known, "n", items=F.when(F.col("n") >= SHINGLE, _hashes(F.col("words"))).otherwise(
            F.array(F.xxhash64(*(F.get("words", k) for k in range(SHINGLE))))  # words that are not there do not count
        ), name="hash", position="offset").distinct(), "spots"
    )
    short = sorted(r["n"] for r in spots.filter(F.col("n") < SHINGLE).select("n").distinct().collect())  # four at most
    if spots.count() <= SMALL_ROWS:
        spots = F.broadcast(spots)
    places = bind(words_of(F.col("text")), lambda w: F.concat(*(F.transform(_hashes(w, size), lambda h, i: F.struct(
        i.alias("place"), h.alias("hash"), F.size(w).alias("total")
    )) for size in (SHINGLE, *short))))
    each = explode_once(rows, "row", items=places, name="at").select("row", "at.place", "at.hash", "at.total")
    hits = each.join(spots, "hash")
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"), F.col("total") - F.col("n")))
    # all windows that hold a short item are equal, so its first one stands for them
    asked = hits.select("row", "n", "hash", start.alias("start"))
    first = asked.filter(F.col("n") < SHINGLE).groupBy("row", "n", "hash").agg(F.min("start").alias("start"))
    wanted = stored(asked.filter(F.col("n") >= SHINGLE).unionByName(first).select("row", "n", "start").distinct(), "wanted")
    touched = stored(wanted.select("row").distinct(), "touched")
    near = rows.join(touched, "row", "left_semi").dropDuplicates(["row"]).select("row", "doc_id", words_of(F.col("text")).alias("words"))
    windows = stored(
        near.join(wanted, "row").select("row", "doc_id", "start", "n", bind(F.slice("words", F.col("start") + 1, F.col("n")), _shingles).alias("shingles")), "windows"
    )
    marked = stored(fingerprints(windows, "row", "start", "n"), "prints")
    part = lambda f, b: F.shiftrightunsigned(f, b * 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    split = lambda f: F.explode(F.array(*(F.struct(F.lit(b).alias("block"), part(f, b).alias("value")) for b in range(BLOCKS)))).alias("at")
    masks = F.filter(F.sequence(F.lit(0), F.lit(0xFFFF)), lambda m: F.bit_count(m) <= BLOCK_RADIUS)
    item_prints = stored(fingerprints(known, "item"), "item-prints")
    index = stored(  # its size is known only when it is written; the planner must not guess it small
        item_prints.select("item", F.col("print").alias("item_print"), split("print")).withColumn("mask", F.explode(masks))
        .select("item", "item_print", "at.block", F.col("at.value").bitwiseXOR(F.col("mask")).alias("value")), "index",
    )
    probes = marked.select("print").distinct().select("print", split("print")).select("print", "at.block", "at.value")
    pairs = stored(
        probes.join(index, ["block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("print", "item").distinct(), "pairs",
    )
    sides = (
        marked.join(pairs, "print").join(windows, ["row", "start", "n"])
        .join(known.select("item", "item_id", "n", F.col("shingles").alias("others")), ["item", "n"])
    )
    both, either = _weight(F.array_intersect("shingles", "others")), _weight(F.array_union("shingles", "others"))
    sure = sides.withColumns({"both": both, "either": either}).filter(F.col("both") * 100 >= F.col("either") * similarity)
    found = F.round(F.col("both") / F.col("either"), 6)
    return sure.groupBy("doc_id", "item_id").agg(
        F.min_by("start", F.struct(-found, F.col("start"))).cast("long").alias("start"), F.max(found).alias("similarity")
    )


SQL = r"""
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), item_spots AS (
  SELECT item_id, w, len(w) AS n, o, array_to_string(list_slice(w, o + 1, o + 5), ' ') AS s
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS o FROM items WHERE len(w) > 0)
), doc_spots AS (
  SELECT doc_id, w, p, array_to_string(list_slice(w, p + 1, p + k), ' ') AS s
  FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM docs JOIN (SELECT 5 AS k UNION SELECT n FROM item_spots WHERE n < 5) ON len(w) >= k)
), starts AS (
  SELECT DISTINCT d.doc_id, i.n, greatest(0, least(d.p - i.o, len(d.w) - i.n)) AS start FROM doc_spots d JOIN item_spots i USING (s)
), windows AS (
  SELECT s.doc_id, s.n, s.start, list_slice(d.w, s.start + 1, s.start + s.n) AS w FROM starts s JOIN docs d USING (doc_id)
), window_sets AS (
  SELECT *, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS a FROM windows
), item_sets AS (
  SELECT item_id, len(w) AS n, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS b
  FROM items WHERE len(w) > 0
), weighed AS (
  SELECT doc_id, item_id, start,
         list_sum(list_transform(list_filter(a, lambda x: list_contains(b, x)), lambda x: length(x))) AS both_w,
         list_sum(list_transform(a, lambda x: length(x))) + list_sum(list_transform(list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: length(x))) AS rest_w,
         list_sum(list_transform(a, lambda x: length(x))) AS a_w
  FROM window_sets JOIN item_sets USING (n) WHERE list_has_any(a, b)
), sums AS (SELECT doc_id, item_id, start, both_w, a_w + coalesce(rest_w - a_w, 0) AS either_w FROM weighed),
sure AS (SELECT *, round(both_w / either_w, 6) AS similarity FROM sums WHERE both_w * 100 >= either_w * 80)
SELECT doc_id, item_id, CAST(arg_min(start, (-similarity, start)) AS bigint) AS start, max(similarity) AS similarity FROM sure GROUP BY doc_id, item_id
"""
