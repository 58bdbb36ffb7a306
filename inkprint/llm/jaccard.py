"""Exact Jaccard join of documents' word shingles, with count-vector R-trees.

1. Shingles are hashed to 64 bits; equal sets form one class, and only classes go on.
2. Sets that are similar enough share one of the first tokens under any common order (prefix
   filter). The order puts tokens that a sketch of all documents finds frequent last.
3. Classes that share such a token and have about the same size meet. Tokens are hashed into
   groups and the group counts are the points of an R-tree: the overlap of two sets is at most the
   sum of the coordinates' minima, that of a set and a box at most the sum with the box's maxima.
   Groups of any size are cut into blocks, and pairs of blocks are tasks of bounded size.
4. Pairs that survive span candidate clusters; the clusters' sets are compared exactly, again by
   R-tree and by blocks, and only links that connect something new leave a task.
5. Connected components of the links, brought back to all documents.

Two different sets share a 64-bit class number with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm import packed as pk
from inkprint.llm.common import components, lookup, stored

SHINGLE, PERCENT = 3, 90
SLOTS = 18  # bits of the frequency sketch: its size is fixed
PER_GROUP = {True: 16, False: 8}  # tokens per coordinate, for similarities from 90 per cent and below
FULL = 255  # a coordinate that may be more: it bounds nothing
LEAF = 16  # entries of a node
MEMBER_BITS = 24  # bits of the filter of clusters' members
BLOCK_ROWS = 1024  # points of a block
BLOCK_BYTES = 4 << 20  # bytes of the sets of a block; a call handles as many of sets
BUCKET_TOKENS = 1 << 19
BUCKET_ROWS = 4_000  # rows that one call handles, about
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class _Words(dict):
    """Hashes of words; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles. ASCII white space separates words, A-Z count as a-z."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    length = min(size, len(h))
    mixed = np.full(len(h) - length + 1, length * 0x51ED27, np.uint64)
    for k in range(length):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _K[0] + h[k : k + len(mixed)] * _K[1]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _K[3]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def class_number(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(a, b, percent: int = PERCENT):
    """The least overlap of sets of these sizes that links them."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def groups_for(n: int, percent: int = PERCENT) -> int:
    """Coordinates of a set's point, a power of two that grows with the set.

    With a few tokens per coordinate, points of unrelated sets of one size are three or four times
    as far apart as points of linked sets can be, whatever the size.
    """
    return 1 << max(0, int(n - 1) // PER_GROUP[percent >= 90]).bit_length()


def counts(tokens: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


class CountTree:
    """An R-tree over count vectors, packed in the order of the sets' sizes."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.tops, self.low, self.high = [], [], []
        tops, low, high = self.points, self.sizes, self.sizes
        while len(tops) > LEAF:
            cuts = np.arange(0, len(tops), LEAF)
            tops, low, high = np.maximum.reduceat(tops, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.tops.append(tops)
            self.low.append(low)
            self.high.append(high)

    def near(self, size: int, point: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Entries whose overlap with the given set may reach what a link needs."""
        at = None
        for level in range(len(self.tops) - 1, -1, -1):
            at = np.arange(len(self.tops[level])) if at is None else at
            fits = (self.high[level][at] * 100 >= percent * size) & (self.low[level][at] * percent <= 100 * size)
            at = at[fits]
            at = at[np.minimum(self.tops[level][at], point).sum(1) >= needed(size, np.maximum(self.low[level][at], -(-percent * size // 100)), percent)]
            width = len(self.tops[level - 1]) if level else len(self.points)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < width]
        at = np.arange(len(self.points)) if at is None else at
        fits = (self.sizes[at] * 100 >= percent * size) & (self.sizes[at] * percent <= 100 * size)
        at = at[fits]
        at = at[np.minimum(self.points[at], point).sum(1) >= needed(size, self.sizes[at], percent)]
        return self.order[at]


class _Union:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[b]] = self.root[a]


def spanning(sizes: np.ndarray, points: np.ndarray, first: np.ndarray, second: np.ndarray, same, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span what the tree and ``same(i, j)`` connect among pairs of one row in ``first`` and one in ``second``."""
    at = np.flatnonzero(second)
    if not len(at) or not first.any():
        return []
    tree, union, found = CountTree(sizes[at], points[at]), _Union(len(sizes)), []
    for i in np.flatnonzero(first):
        for j in at[tree.near(int(sizes[i]), points[i], percent)]:
            if i != j and union.root[i] != union.root[j] and same(i, j):
                union.join(i, j)
                found.append((int(i), int(j)))
    return found


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, node (class number, null without words), prefix tokens and count vector. Two passes, no shuffle of texts."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = _Words(), np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total[(shingle_set(value.as_py(), words, size) >> np.uint64(64 - SLOTS)).astype(np.int64)] += 1  # few meet in a slot of one text
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype("i4")), pa.array(total[slots])], ["slot", "n"])

    tallied = narrow.select("text").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    load = np.ones(1 << SLOTS)
    load[tallied["slot"].to_numpy(np.int64)] = tallied["n"].to_numpy(float)
    level = np.floor(4 * np.log2(np.maximum(1, load / max(1.0, load.mean())))).astype(np.uint8)  # a rank of frequency, not a limit
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, levels = _Words(), shared.value
        for batch in batches:
            n, node, prefix, vector = [], [], [], []
            for value in batch.column(1):
                tokens = shingle_set(value.as_py(), words, size)
                n.append(len(tokens))
                if not len(tokens):
                    node.append(None)
                    prefix.append(None)
                    vector.append(None)
                    continue
                node.append(class_number(tokens))
                rank = levels[(tokens >> np.uint64(64 - SLOTS)).astype(np.int64)]
                prefix.append(tokens[np.lexsort((tokens, rank))][: prefix_length(len(tokens), percent)].view(np.int64))
                vector.append(np.minimum(counts(tokens, groups_for(len(tokens), percent)), FULL).astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(vector, pa.binary())],
                ["doc_id", "n_shingles", "node", "prefix", "vector"],
            )

    return narrow.mapInArrow(sign, "doc_id long, n_shingles long, node long, prefix array<long>, vector binary")


def _pairs_of_blocks(rows: DataFrame, keys: list[str], sizes: DataFrame, blocks: Column) -> DataFrame:
    """Each row once per pair of blocks of its group: ``own`` (block), ``i`` <= ``j``; groups have ``blocks`` blocks."""
    wide = rows.join(sizes.select(*keys, blocks.alias("blocks")), keys).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    each = wide.withColumn("other", F.explode(others))
    return each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def _in_buckets(rows: DataFrame, keys: list[str], n: int):
    buckets = max(1, -(-n // BUCKET_ROWS))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def _groups(table: pa.Table, keys: list[str]) -> Iterator[np.ndarray]:
    columns = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    if len(order):
        new = np.zeros(len(order), bool)
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        yield from np.split(order, np.flatnonzero(new))


def _edges(pairs: list[tuple[int, int]], nodes: np.ndarray) -> pa.Table:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(nodes[at[:, 0]]), "b": pa.array(nodes[at[:, 1]])})


def candidates(signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes that span the clusters in which links can be; ``signed`` is stored."""
    some = signed.filter("node IS NOT NULL")
    total = some.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_TOKENS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = (np.asarray(v.values).view(np.uint64) for v in batch.column(1))
            yield from pk.ask_shared([(node, np.unique(pk.key_of(p, buckets))) for node, p in zip(batch.column(0).to_pylist(), prefixes)], buckets)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = pk.pairs(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes)], ["token", "node"])

    told = some.select("node", "prefix").mapInArrow(ask, pk.SENT_DDL).groupBy("bucket").applyInArrow(pk.tell_shared(buckets), pk.SAID_DDL)
    points_of = stored(some.select("node", "n_shingles", "vector").dropDuplicates(["node"]), "points")
    met = told.select("data").mapInArrow(unpack, "token long, node long").distinct().join(
        points_of.select("node", F.col("n_shingles").cast("int").alias("size")), "node"
    )
    # sizes of linked sets differ by a band at most: each set visits the band above its own
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9))).cast("int")
    spread = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("visits")), F.struct((band + 1).alias("band"), F.lit(True).alias("visits"))))
    shared = stored(met.select("token", "node", spread.alias("at")).select("token", "node", "at.*"), "shared")
    sizes = stored(
        shared.groupBy("token", "band").agg(F.count("*").alias("n"), F.count_if(~F.col("visits")).alias("own_n")).filter("n > 1 AND own_n > 0"), "sizes"
    )
    keys = ["token", "band"]
    rows = _pairs_of_blocks(shared, keys, sizes, F.ceil(F.col("n") / BLOCK_ROWS)).join(points_of, "node")
    total = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK_ROWS))).first()[0] or 0

    def pair(table: pa.Table) -> pa.Table:
        nodes, n = table.column("node").to_numpy(), table.column("n_shingles").to_numpy()
        visits, own, i, j = (table.column(c).to_numpy(zero_copy_only=False) for c in ("visits", "own", "i", "j"))
        vectors = table.column("vector").to_pylist()
        width = np.array([len(v) for v in vectors], np.int64)
        by_width = {}
        for w in np.unique(width).tolist():  # points of w coordinates, those of twice as many folded
            at = np.flatnonzero((width == w) | (width == 2 * w))
            place = np.zeros(len(n), np.int64)
            place[at] = np.arange(len(at))
            read = lambda k: np.frombuffer(vectors[k], "u1").astype(np.int16)
            lift = lambda v: np.where(v == FULL, 1 << 13, v)
            points = np.stack([lift(read(k)) if width[k] == w else lift(read(k)).reshape(2, w).sum(0) for k in at]).astype(np.int16)
            by_width[w] = place, points
        found: list[tuple[int, int]] = []
        small_a, small_b = [], []
        for group in _groups(table, ["token", "band", "i", "j"]):
            if len(group) < 2:
                continue
            if len(group) <= LEAF:
                a, b = np.triu_indices(len(group), 1)
                small_a.append(group[a])
                small_b.append(group[b])
                continue
            place, points = by_width[int(width[group].min())]  # sizes of a group differ by less than half
            points = points[place[group]]
            in_i, in_j = own[group] == i[group], own[group] == j[group]
            sides = [(in_i, in_j)] if i[group[0]] == j[group[0]] else [(in_i, in_j), (in_j, in_i)]
            for first, second in sides:
                found += [(int(group[a]), int(group[b])) for a, b in spanning(n[group], points, first, second & ~visits[group], lambda a, b: True, percent)]
        if small_a:
            a, b = np.concatenate(small_a), np.concatenate(small_b)
            near = (nodes[a] != nodes[b]) & ~(visits[a] & visits[b]) & (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b]))
            a, b = a[near], b[near]
            level = np.minimum(width[a], width[b])
            for w, (place, points) in by_width.items():
                x, y = a[level == w], b[level == w]
                step = max(1, (1 << 22) // w)
                for start in range(0, len(x), step):
                    k, m = x[start : start + step], y[start : start + step]
                    passed = np.minimum(points[place[k]], points[place[m]]).sum(1) >= needed(n[k], n[m], percent)
                    found += list(zip(k[passed].tolist(), m[passed].tolist()))
        return _edges(found, nodes)

    edges = _in_buckets(rows, ["token", "band", "i", "j"], total).applyInArrow(pair, "a long, b long")
    return stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, doc_id: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b), verified on the whole sets, that span the components inside each cluster (node, label).

    The sets are made from the texts again. A bitmap of fixed size over the ids of the clusters'
    members keeps other texts out; what it lets through by chance the join drops.
    """
    members = stored(classes.join(clusters, "node").select("node", "label", "n_shingles", "rep"), "members")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MEMBER_BITS))
    set_bits = members.select((slot("rep") + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bitmap = np.zeros(1 << (MEMBER_BITS - 3), np.uint8)
    for row in set_bits.collect():  # numbers from 1 on, 4 KiB for each 2 ** 15 of them
        bitmap[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _Words(), shared.value
        for batch in batches:
            slots = batch.column(0).to_numpy()
            hits = np.flatnonzero(known[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
            sets = [shingle_set(batch.column(1)[int(i)].as_py(), words, size) for i in hits]
            sets = [tokens for tokens in sets if len(tokens)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_number(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "tokens"]
            )

    made = docs.select(slot(F.col(doc_id).cast("long")).alias("slot"), F.col(text).alias("text")).mapInArrow(collect, "node long, tokens binary")
    sets = stored(made.join(members.select("node", "label"), "node").dropDuplicates(["node"]), "sets")
    sizes = stored(members.groupBy("label").agg(F.sum("n_shingles").alias("n"), F.count("*").alias("rows")), "clusters")
    blocks = F.ceil(F.greatest(F.col("n") * 8 / BLOCK_BYTES, F.col("rows") / BLOCK_ROWS)).cast("long")
    rows = _pairs_of_blocks(sets, ["label"], sizes, blocks)
    sent = sizes.agg(F.sum(F.col("n") * 8 * blocks)).first()[0] or 0

    def verify(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("tokens")]
        found: list[tuple[int, int]] = []
        for group in _groups(table, ["label", "i", "j"]):
            n = np.array([len(sets[g]) for g in group])
            groups = int(min(4096, max(64, 1 << int(n.max() - 1).bit_length())))
            points = np.stack([np.minimum(counts(sets[g], groups), 1 << 14).astype(np.int16) for g in group])
            points[points == 1 << 14] = 32767  # may be more

            def same(a: int, b: int) -> bool:
                x, y = sets[group[a]], sets[group[b]]
                at = np.searchsorted(x, y)
                both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                return 100 * both >= percent * (len(x) + len(y) - both)

            in_i, in_j = own[group] == i[group], own[group] == j[group]
            found += [(int(group[a]), int(group[b])) for a, b in spanning(n, points, in_i, in_j, same, percent)]
        return _edges(found, nodes)

    return stored(_in_buckets(rows, ["label", "i", "j"], int(sent) * BUCKET_ROWS // BLOCK_BYTES).applyInArrow(verify, "a long, b long").filter("a != b"), "verified")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Texts without words (null, empty, white space) have no shingles and stay alone; with fewer
    words than ``size`` the whole sequence is the one shingle. Equal sets are linked. Repeated rows
    give a row each; null ids never become a component's id unless it has no other. Other columns
    are left out.
    """
    spark = docs.sparkSession
    signed = stored(signatures(docs, doc_id, text, size, percent), "signatures")
    total = signed.count()
    groups = stored(
        signed.filter("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies")), "classes",
    )
    clusters = components(spark, candidates(signed, percent), "long")
    found = components(spark, links(docs, groups, clusters, doc_id, text, size, percent), "long")
    named = found.join(groups.select("node", "rep", "copies"), "node")
    lowest_of = stored(named.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("nodes")), "lowest")
    linked = lookup(stored(named, "named"), lowest_of, "label", "nodes", found.count(), "inner").select("node", "component", "copies")
    copies = groups.filter("copies > 1").join(found.select("node"), "node", "left_anti").select("node", F.col("rep").alias("component"), "copies")
    known = stored(linked.unionByName(copies), "known")
    return lookup(signed.select("doc_id", "n_shingles", "node"), known, "node", "copies", total).select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
