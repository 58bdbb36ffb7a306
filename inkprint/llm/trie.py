"""The prefix trie of conversations: union-find over sorted neighbours' common prefixes.

Different sequences of turns are sorted, and every neighbour pair is an edge as deep as the prefix
both share. Taken in descending depth, an edge merges two components where two branches meet; at
each depth a component is a node. Every partition of the sorted sequences builds its own forest.
What its first and its last sequence run through may go on in the partitions before and after, so
these two paths are given out contracted: per depth the sums of what hangs off them. They are again
sorted sequences with neighbours, and the same steps merge them, some partitions at a time, until
one forest is left.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import stored

BASE = 5  # conversations begin with turns of the nearest id below that this divides
MOST_HEAD = 8  # turns they take over at most
MERGED = 64  # partitions whose paths one task merges
RUN = 4096  # ids of a sequence that are joined in one row
ROWS_OUT = 4096  # rows of a record batch that a task gives out
NONE_END = hashlib.sha256(b"").hexdigest()
FAR = (1 << 63) - 1

_EXTRA = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()),
                    ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
_ROW = pa.schema([
    ("part", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("key", pa.binary()), ("parent_key", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("extras", pa.list_(_EXTRA)),
])
_ROW_DDL = (
    "part int, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, key binary, parent_key binary, digests array<binary>, sizes array<long>, "
    "extras array<struct<depth:long,n:long,least:long,children:long,leaves:long,saved:long,ends:string>>"
)
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


class Extra(NamedTuple):
    """What hangs off a sequence at one depth without going on along it."""

    depth: int
    n: int  # conversations
    least: int  # their smallest id
    children: int  # whole nodes one deeper
    leaves: int  # childless nodes below these
    saved: int  # sums below these
    ends: str | None  # digest of the ids that end here


class Path(NamedTuple):
    """A sequence of turns: a digest and the text's bytes of each, and what hangs off it."""

    digests: list[bytes]
    sizes: list[int]
    extras: list[Extra]


class _Node:
    """A component at one depth, and the whole nodes one deeper that it has merged."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "ends", "below")

    def __init__(self) -> None:
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, FAR, 0, 0, 0, None
        self.below: list[tuple] = []

    def add(self, n: int, least: int, children: int, leaves: int, saved: int, ends: str | None) -> None:
        self.n += n
        self.least = min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = self.ends or ends

    def take(self, other: _Node) -> None:
        self.add(other.n, other.least, other.children, other.leaves, other.saved, other.ends)
        self.below += other.below


def common(a: list[bytes], b: list[bytes]) -> int:
    """Turns at the beginning that both sequences have."""
    for at, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return at
    return min(len(a), len(b))


def prefix_keys(digests: list[bytes]) -> list[bytes]:
    """A key of each prefix, the empty one first."""
    running = hashlib.md5()
    keys = [running.digest()]
    for d in digests:
        running.update(d)
        keys.append(running.digest())
    return keys


def forest(paths: list[Path], whole: bool, keyed: bool, left: list[Path]) -> Iterator[tuple]:
    """The nodes of sorted sequences, as rows; the contracted first and last sequence go to ``left``.

    If ``whole`` is false the nodes of these two stay open: no row is made of them, their children
    carry the key of the parent, and what hangs off them is in the paths left. ``keyed`` nodes tell
    their own keys.
    """
    if not paths:
        return
    last = len(paths) - 1
    ends_at, meets_at, extras_at = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, p in enumerate(paths):
        ends_at[len(p.digests)].append(i)
        for extra in p.extras:
            extras_at[extra.depth].append((i, extra))
    for i, (a, b) in enumerate(pairwise(paths), 1):
        meets_at[common(a.digests, b.digests)].append(i)
    keys = {i: prefix_keys(paths[i].digests) for i in (range(last + 1) if keyed else {0, last})}
    above = list(range(last + 1))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    open_extras: dict[int, list[Extra]] = {0: [], last: []}
    live: dict[int, _Node] = {}  # by the component's root, its smallest sequence
    for depth in range(max(ends_at), -1, -1):
        nodes: dict[int, _Node] = {}
        for root, deeper in live.items():
            node = nodes[root] = _Node()
            if deeper.below is not None:  # else it stays open and is counted where it is closed
                node.add(deeper.n, deeper.least, 1, deeper.leaves, deeper.saved, None)
                node.below.append((root, deeper))
        for i in ends_at[depth]:
            nodes[i] = _Node()
        for i in meets_at[depth]:
            a, b = find(i - 1), find(i)
            above[b] = a
            nodes[a].take(nodes.pop(b))
        for i, extra in extras_at[depth]:
            nodes[find(i)].add(*extra[1:])
        at_ends = () if whole else {0: find(0) if 0 in nodes else None, last: find(last) if find(last) in nodes else None}
        for root, node in nodes.items():
            side = 0 if not whole and root == at_ends[0] else last if not whole and root == at_ends[last] else None
            for origin, child in node.below:
                yield (
                    depth + 1, child.least, node.least if side is None else None, child.n, child.children, child.leaves, child.saved,
                    child.ends or NONE_END, keys[origin][depth + 1] if keyed else None, None if side is None else keys[side][depth],
                )
            if side is None:
                node.below = []
                node.leaves = node.leaves if node.children else 1
                node.saved += (node.n - 1) * (paths[root].sizes[depth - 1] if depth else 0)
            else:
                node.below = None
                if node.n or node.ends:
                    open_extras[side].append(Extra(depth, node.n, node.least, node.children, node.leaves, node.saved, node.ends))
        live = nodes
    if not whole:
        left += [Path(paths[i].digests, paths[i].sizes, open_extras[i]) for i in sorted({0, last})]
        return
    for origin, node in live.items():  # the root
        yield (
            0, node.least, None, node.n, node.children, node.leaves, node.saved, node.ends or NONE_END, keys[origin][0] if keyed else None, None,
        )


def _given_out(part: int, paths: list[Path], whole: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes, then of the paths that stay open."""
    left: list[Path] = []
    nodes = ((part, None, *row, None, None, None) for row in forest(paths, whole, keyed, left))
    open_paths = ((part, side, *[None] * 10, p.digests, p.sizes, [e._asdict() for e in p.extras]) for side, p in enumerate(left))
    told = chain(nodes, open_paths)  # the paths are left once the nodes are through
    while rows := list(islice(told, ROWS_OUT)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition of sorted sequences: conv_id, n, ends, digests, sizes."""
    paths: list[Path] = []
    for batch in batches:
        for conv, n, ends, digests, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            paths.append(Path(digests, sizes, [Extra(len(digests), n, conv, 0, 0, 0, ends)]))
    yield from _given_out(TaskContext.get().partitionId(), paths, whole=False, keyed=False)


def _merge(whole: bool):
    def run(group: pa.Table) -> pa.Table:
        told = sorted(group.to_pylist(), key=lambda r: (r["part"], r["side"]))
        paths = [Path(r["digests"], r["sizes"], [Extra(**e) for e in r["extras"]]) for r in told]
        return pa.Table.from_batches(_given_out(told[0]["part"] // MERGED, paths, whole, keyed=True), _ROW)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sequence, conv_id), sorted by both: the ids of a sequence joined by commas, some thousands a row."""
    now, first, ids = None, None, []
    schema = pa.schema([("sequence", pa.string()), ("first", pa.int64()), ("ids", pa.string())])

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        rows = []
        for sequence, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if sequence != now or len(ids) == RUN:
                if ids:
                    rows.append((now, first, ",".join(ids)))
                now, first, ids = sequence, conv, []
            ids.append(str(conv))
        if rows:
            yield told()
    if ids:
        rows = [(now, first, ",".join(ids))]
        yield told()


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sequence, first, ids), sorted by the first two: a digest per sequence over its ids, read as a stream."""
    now, running = None, None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["sequence", "ends"])

    for batch in batches:
        rows = []
        for sequence, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if sequence != now:
                if now is not None:
                    rows.append((now, running.hexdigest()))
                now, running = sequence, hashlib.sha256(ids.encode())
            else:
                running.update(f",{ids}".encode())
        if rows:
            yield told(rows)
    if now is not None:
        yield told([(now, running.hexdigest())])


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id and ``turns``, an array of (digest of role and text, bytes of the text) in order.

    Turns are ordered by ``turn``, null first; equal turns by role, then by text. A null role or
    text is empty; rows without a conversation's id belong to none. The order comes from one sort
    of all rows, so that texts of one long conversation are spread; after it only 28 bytes a turn
    go on, and those of one conversation make one row.
    """
    order = ("conv_id", "turn", "role", "text")
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("place"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        F.octet_length("text").cast("long").alias("size"),
    )
    own = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "size"))).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuild(own: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % 5 before its own turns after its first h; h is crc32(c) % 9."""
    own = stored(own, "turns")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).withColumn("h", h).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def nodes(built: DataFrame) -> DataFrame:
    """One row per different prefix of ``turns``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations of the same turns are counted first and go on as one sequence, however many they
    are; their ids are sorted and joined in many tasks, only the digest reads one after the other. A
    conversation without turns is a member of the root; without conversations there are no nodes.
    ``conv_id`` must be unique, as ``sequences`` makes it.
    """
    digests = F.transform("turns", lambda t: t["digest"])
    one = F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    built = stored(built.select("conv_id", one.alias("sequence"), digests.alias("digests"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "sequences")
    counted = stored(built.groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "counted")
    copies = counted.filter("n > 1")
    streamed = (
        built.select("sequence", "conv_id").join(copies.select("sequence"), "sequence", "left_semi")
        .repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id").mapInArrow(_runs, "sequence string, first long, ids string")
        .repartition("sequence").sortWithinPartitions("sequence", "first").mapInArrow(_end_digests, "sequence string, ends string")
    )
    single = counted.filter("n = 1").select("conv_id", "n", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"))
    different = single.unionByName(copies.join(streamed, "sequence").select("conv_id", "n", "ends"))
    items = stored(different.join(built.drop("sequence"), "conv_id").select("conv_id", "n", "ends", "digests", "sizes"), "items")
    level = stored(items.repartitionByRange("digests").sortWithinPartitions("digests").mapInArrow(_base, _ROW_DDL), "forest")
    made = [level.filter("side IS NULL")]
    while True:
        most = level.agg(F.max("part")).first()[0]
        if most is None:
            break
        whole = most < MERGED
        paths = level.filter("side IS NOT NULL").withColumn("into", F.expr(f"part div {MERGED}"))
        level = stored(paths.groupBy("into").applyInArrow(_merge(whole), _ROW_DDL), "forest")
        made.append(level.filter("side IS NULL"))
        if whole:
            break
    return _with_parents(made)


def _with_parents(made: list[DataFrame]) -> DataFrame:
    """All nodes; those whose parent was closed later look it up by its key, of which there are two paths a partition at most."""
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    closed = every.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    waiting = every.filter("parent_key IS NOT NULL").join(closed, "parent_key").withColumn("parent_conv_id", F.col("found"))
    return every.filter("parent_key IS NULL").select(*NODE).unionByName(waiting.select(*NODE))


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations; an empty table gives no rows, other columns are left out."""
    return nodes(rebuild(sequences(conversations, conv_id, turn, role, text)))


SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id AS c, conv_id - conv_id % {BASE} AS base,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
         )) % {MOST_HEAD + 1} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d
  FROM (SELECT c, role, text, k, 0 AS own FROM ids JOIN turns ON conv_id = base AND k <= h
        UNION ALL SELECT c, role, text, k, 1 FROM ids JOIN turns ON conv_id = c AND k > h)
), chained AS (
  SELECT c, d, strlen(text) AS bytes, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS key FROM rebuilt
), prefixes AS (
  SELECT c, 0 AS d, 0 AS bytes, '' AS key FROM ids UNION ALL SELECT c, d, bytes, key FROM chained
), members AS (
  SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS is_end FROM prefixes
), nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends
  FROM members GROUP BY key
), children AS (SELECT parent AS key, count(*) AS n FROM nodes GROUP BY parent),
below AS (
  SELECT m.key, sum(u.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes u LEFT JOIN children k USING (key) JOIN members m ON m.c = u.c AND m.d <= u.d GROUP BY m.key
)
SELECT nodes.c AS conv_id, nodes.d::BIGINT AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, coalesce(children.n, 0) AS n_children,
       below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN below USING (key) LEFT JOIN children USING (key) LEFT JOIN nodes up ON up.key = nodes.parent
"""
