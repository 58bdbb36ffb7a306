"""Hard negatives by inner product, found in cover trees over norm-augmented rows.

A further component gives all rows the same norm, so that a large inner product is a small distance.
Rows near the same pivot make a region, a region is dealt out to shards of bounded size, and a shard
holds cover trees: a node's ball covers its rows, its children's balls of smaller radius cover them
again. Distance to a centre and covering radius bound the inner products below a node from both
sides. Anchors go down best bound first, leave out nodes whose bounds miss their window or the best
rows found so far, and compare the rows of leaves exactly.

Every anchor first asks the shard it would lie in itself; what it finds there is the least it will
accept from the other regions, and the same bounds tell which regions need no visit at all.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import stored

SCALE = 256  # a component becomes floor(SCALE * x)
EVERY = 50  # rows whose ids this divides are anchors
POSITIVES, NEGATIVES = 5, 3
REGIONS = 256  # pivots at most; they are sent to every task
CELLS = 1 << 19  # components a shard holds about
BLOCK = 2048  # rows of a cover tree
LEAF = 16
STEP = 1.5  # radii of children are smaller than the parent's by this factor
SLICE = 1 << 14  # anchors that meet a shard at once
EXACT = float(1 << 52)  # inner products below it are exact in doubles
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Space(NamedTuple):
    """What all rows share: longest vector, largest square of a norm, pivots, shards of each region."""

    dims: int
    square: float
    pivots: np.ndarray
    parts: list[int]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that gives them all the largest norm."""
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))[:, None]])

    @property
    def slack(self) -> float:
        """What rounding can take from a distance, with room to spare."""
        return 1e-6 * self.square**0.5 + 1e-9

    @property
    def kind(self) -> type:
        return np.float64 if self.square < EXACT else object


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Integer rows; shorter ones end in zeros."""
    rows = vectors.to_pylist()
    x = np.zeros((len(rows), dims), np.int64)
    for i, row in enumerate(rows):
        x[i, : len(row)] = row
    return x


def bounds(score: np.ndarray, radius: np.ndarray, query: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of queries (squares of their norms) with anything in a ball whose centre has ``score``."""
    both = query[:, None] + space.square
    away = np.sqrt(np.maximum(both - 2 * score.astype(np.float64), 0))
    radius = radius + space.slack
    room = 1e-9 * both + 1e-6
    return (both - (away + radius) ** 2) / 2 - room, (both - np.maximum(away - radius, 0) ** 2) / 2 + room


# --- trees -----------------------------------------------------------------------------------------


def blocks(lifted: np.ndarray) -> Iterator[np.ndarray]:
    """Places of at most ``BLOCK`` rows that lie together: halves along the way from the first row to the farthest one."""
    waiting = [np.arange(len(lifted))]
    while waiting:
        at = waiting.pop()
        if len(at) <= BLOCK:
            yield at
            continue
        x = lifted[at]
        way = x[np.argmax(((x - x[0]) ** 2).sum(1))] - x[0]
        order = np.argsort(x @ way, kind="stable")
        waiting += [np.sort(at[half]) for half in np.array_split(order, 2)]


def cover(lifted: np.ndarray, square: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the nodes (centre, radius, first row, end, first child, end) of a cover tree over them.

    A node's rows are contiguous in the order and begin with its centre. Its children's centres are
    farther from each other than the radius its children may have, the first of them is its own.
    """
    away = np.sqrt(np.maximum(2 * (square - lifted @ lifted.T), 0))
    np.fill_diagonal(away, 0)
    order = np.arange(len(lifted))
    nodes = [[0, 0.0, 0, len(order), 0, 0]]
    at = 0
    while at < len(nodes):
        node = nodes[at]
        own = order[node[2] : node[3]].copy()
        node[0], node[1] = node[2], float(away[own[0], own].max())
        if len(own) > LEAF and node[1] > slack:
            node[4], place = len(nodes), node[2]
            while len(own):
                near = away[own[0], own] <= node[1] / STEP
                near[0] = True
                n = int(near.sum())
                order[place : place + n] = own[near]
                nodes.append([0, 0.0, place, place + n, 0, 0])
                own, place = own[~near], place + n
            node[5] = len(nodes)
        at += 1
    return order, np.array(nodes)


class Trees(NamedTuple):
    """The cover trees of a shard; ``nodes`` name rows of ``x``, ``roots`` the trees' first nodes."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    nodes: np.ndarray
    roots: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self._asdict())
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Trees:
        with np.load(io.BytesIO(data)) as held:
            return cls(*(held[f] for f in cls._fields))

    @classmethod
    def over(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, space: Space) -> Trees:
        by_id = np.argsort(ids, kind="stable")
        lifted = space.lift(x[by_id])
        order, nodes, roots, rows, total = [], [], [], 0, 0
        for block in blocks(lifted):
            own, made = cover(lifted[block], space.square, space.slack)
            made[:, [0, 2, 3]] += rows
            made[:, [4, 5]] += np.where(made[:, [5]] > 0, total, 0)
            roots.append(total)
            order.append(by_id[block[own]])
            nodes.append(made)
            rows, total = rows + len(own), total + len(made)
        order = np.concatenate(order)
        return cls(ids[order], labels[order], x[order], np.concatenate(nodes), np.array(roots))


class Asked(NamedTuple):
    """Anchors, and for each its windows: scores from ``low`` to ``high``; a window with low > high is empty."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Search:
    """The ``most`` best rows of each window of each anchor in some trees, of the anchors' own label or of others."""

    def __init__(self, trees: Trees, asked: Asked, space: Space, same: bool, most: int):
        self.trees, self.asked, self.space, self.same, self.most = trees, asked, space, same, most
        self.x, self.q = trees.x.astype(space.kind), asked.x.astype(space.kind)
        self.square = (asked.x.astype(np.float64) ** 2).sum(1)
        self.score = np.full((*asked.low.shape, most), LEAST, np.int64)
        self.found = np.full((*asked.low.shape, most), MOST, np.int64)
        self.least = asked.low.copy()  # what a window takes now
        self.span = trees.nodes[:, 2:].astype(np.int64)
        self.rows_seen = 0  # inner products computed, for tests
        heap: list[tuple] = []
        self._meet(trees.roots, np.arange(len(asked.ids)), heap)
        while heap:
            _, _, node, anchors, upper = heapq.heappop(heap)
            anchors = anchors[(upper[:, None] >= self.least[anchors]).any(1)]
            if not len(anchors):
                continue
            first, end, child, last = self.span[node]
            if last:
                self._meet(np.arange(child, last), anchors, heap)
            else:
                self._compare(anchors, np.arange(first, end), self._scores(anchors, np.arange(first, end)))

    def _scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.rows_seen += len(anchors) * len(rows)
        score = self.q[anchors] @ self.x[rows].T
        if self.space.kind is object:
            return np.clip(score, LEAST, MOST).astype(np.int64)
        return score.astype(np.int64)

    def _meet(self, nodes: np.ndarray, anchors: np.ndarray, heap: list[tuple]) -> None:
        """Leaves of one row are compared at once, other nodes wait by their best bound."""
        centre = self.trees.nodes[nodes, 0].astype(np.int64)
        score = self._scores(anchors, centre)
        alone = self.span[nodes, 1] - self.span[nodes, 0] == 1
        if alone.any():
            self._compare(anchors, centre[alone], score[:, alone])
        rest = np.flatnonzero(~alone)
        if not len(rest):
            return
        lower, upper = bounds(score[:, rest], self.trees.nodes[nodes[rest], 1], self.square[anchors], self.space)
        wanted = np.zeros(upper.shape, bool)
        for w in range(self.least.shape[1]):
            wanted |= (upper >= self.least[anchors, w, None]) & (lower <= self.asked.high[anchors, w, None])
        for k in np.flatnonzero(wanted.any(0)):
            of = wanted[:, k]
            heapq.heappush(heap, (-float(upper[of, k].max()), int(nodes[rest[k]]), nodes[rest[k]], anchors[of], upper[of, k]))

    def _compare(self, anchors: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        ids, alike = self.trees.ids[rows], self.trees.labels[rows] == self.asked.labels[anchors, None]
        fits = alike & (ids != self.asked.ids[anchors, None]) if self.same else ~alike
        for w in range(self.least.shape[1]):
            good = fits & (score >= self.least[anchors, w, None]) & (score <= self.asked.high[anchors, w, None])
            own = np.flatnonzero(good.any(1))
            if not len(own):
                continue
            values, good = score[own], good[own]
            if values.shape[1] > self.most:  # no more than the best and what ties with the last of them
                ranked = np.where(good, values, LEAST)
                good &= ranked >= np.partition(ranked, -self.most, axis=1)[:, [-self.most]]
            who, what = np.nonzero(good)
            at = anchors[own]
            held = self.found[at, w] != MOST
            before = np.nonzero(held)
            line = np.concatenate([who, before[0]])
            value = np.concatenate([values[who, what], self.score[at, w][held]])
            name = np.concatenate([ids[what], self.found[at, w][held]])
            order = np.lexsort((name, -value.astype(np.float64) if self.space.kind is object else -value, line))
            line, value, name = line[order], value[order], name[order]
            nth = np.arange(len(line)) - np.searchsorted(line, line)
            top = nth < self.most
            self.score[at[line[top]], w, nth[top]] = value[top]
            self.found[at[line[top]], w, nth[top]] = name[top]
            full = self.found[at, w, -1] != MOST
            self.least[at[full], w] = np.maximum(self.least[at[full], w], self.score[at[full], w, -1])

    def rows(self) -> tuple[np.ndarray, ...]:
        """Anchor, window, score and id of everything found."""
        a, w, k = np.nonzero(self.found != MOST)
        return self.asked.ids[a], w.astype(np.int32), self.score[a, w, k], self.found[a, w, k]


# --- Spark -----------------------------------------------------------------------------------------


def prepared(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that take part: vec_id, label, x (integers).

    A row without id, label or vector, or with a null or non-finite component, takes no part. Of
    several rows of one id the one with the smallest label, then the smallest vector, takes part.
    """
    held = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x"))
    fine = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))  # noqa: E731  NaN is the largest
    held = held.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(F.forall("x", fine))
    rows = held.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("x", lambda v: F.floor(v.cast("double") * SCALE)).alias("x"),
    )
    rows = stored(rows, "rows")
    twice = rows.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(one.select("vec_id", "r.label", "r.x"))


def _region(space_of: Callable[[], Space]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_of()
        lifted = space.lift(space.pivots)
        for batch in batches:
            x = space.lift(matrix(batch.column(2), space.dims))
            region = pa.array(np.argmax(x @ lifted.T, axis=1) if len(x) else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, region], [*batch.schema.names, "region"])

    return run


def _grow(space_of: Callable[[], Space]):
    def run(group: pa.Table) -> pa.Table:
        space = space_of()
        x = matrix(group.column("x"), space.dims)
        trees = Trees.over(group.column("vec_id").to_numpy(), group.column("label").to_numpy(), x, space)
        region = group.column("region")[0].as_py()
        pivot, lifted = space.lift(space.pivots[region : region + 1]), space.lift(x)
        radius = float(np.sqrt(np.maximum(2 * (space.square - lifted @ pivot.T), 0)).max())
        return pa.table({"shard": group.column("shard")[:1], "region": group.column("region")[:1], "radius": [radius], "trees": pa.array([trees.packed()], pa.binary())})

    return run


def _route(space_of: Callable[[], Space], radii: list[float], home: bool, slices: int):
    """Packs anchors for the shards they have to ask: that of their own place, or those of every region whose bounds meet a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = space_of()
        lifted, radius = space.lift(space.pivots), np.array(radii)
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in (0, 1))
            x = matrix(batch.column(2), space.dims)
            low, high = (np.array(batch.column(c).to_pylist(), np.int64).reshape(len(ids), -1) for c in (3, 4))
            if home:
                near = np.argmax(space.lift(x) @ lifted.T, axis=1) if len(ids) else np.zeros(0, int)
                wanted = near[:, None] == np.arange(len(radius))
            else:
                wanted = np.zeros((len(ids), len(radius)), bool)
                square = (x.astype(np.float64) ** 2).sum(1)
                away_lower, away_upper = bounds(x.astype(np.float64) @ lifted[:, :-1].T, radius, square, space)
                for w in range(low.shape[1]):
                    wanted |= (away_upper >= low[:, [w]]) & (away_lower <= high[:, [w]]) & (low[:, [w]] <= high[:, [w]])
            wanted &= radius >= 0  # a region without rows
            data = np.hstack([ids[:, None], labels[:, None], low, high, x])
            part, out = np.abs(ids // EVERY) % slices, []
            for region in np.flatnonzero(wanted.any(0)):
                for s in np.unique(part[wanted[:, region]]):
                    chosen = np.ascontiguousarray(data[wanted[:, region] & (part == s)]).tobytes()
                    out += [(int(region) << 32 | k, int(s), low.shape[1], chosen) for k in ([0] if home else range(space.parts[region]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["shard", "slice", "windows", "data"])

    return run


_FOUND = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _answer(space_of: Callable[[], Space], same: bool, most: int):
    def run(asked: pa.Table, trees: pa.Table) -> pa.Table:
        if not len(asked) or not len(trees):
            return _FOUND.empty_table()
        space, held = space_of(), Trees.unpacked(trees.column("trees")[0].as_py())
        windows = asked.column("windows")[0].as_py()
        data = np.frombuffer(b"".join(asked.column("data").to_pylist()), np.int64).reshape(-1, 2 + 2 * windows + space.dims)
        found = []
        for at in range(0, len(data), 512):  # so many anchors go down together
            d = data[at : at + 512]
            cuts = np.split(d, [1, 2, 2 + windows, 2 + 2 * windows], axis=1)
            found.append(Search(held, Asked(cuts[0][:, 0], cuts[1][:, 0], cuts[4], cuts[2], cuts[3]), space, same, most).rows())
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_FOUND)

    return run


class Index:
    """Cover trees over all rows of ``rows`` (vec_id, label, x), written to the shared folder."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.rows = rows = stored(rows, "rows")
        square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        dims, most, n = rows.agg(F.max(F.size("x")), F.max(square), F.count("*")).first()
        self.dims, self.n = max(dims or 0, 1), n
        per_shard = max(LEAF, CELLS // self.dims)
        # pivots are a bounded sample; the rows themselves all go into the index
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(REGIONS, -(-n // per_shard)))).select("x")
        pivots = matrix(pa.array([r["x"] for r in sample.collect()], pa.list_(pa.int64())), self.dims)
        self.space = Space(self.dims, most or 0.0, pivots, [])
        placed = stored(rows.mapInArrow(_region(self._shared()), "vec_id long, label long, x array<long>, region int"), "regions")
        counts = {r["region"]: r["count"] for r in placed.groupBy("region").count().collect()}  # one row a pivot
        parts = [-(-counts.get(r, 0) // per_shard) for r in range(len(pivots))]
        self.space = self.space._replace(parts=parts)
        shared = self._shared()
        part = F.pmod(F.xxhash64("vec_id"), F.get(F.array(*[F.lit(max(1, p)) for p in parts] or [F.lit(1)]), F.col("region")))
        shard = F.shiftleft(F.col("region").cast("long"), 32).bitwiseOR(part.cast("long"))
        self.trees = stored(
            placed.withColumn("shard", shard).groupBy("shard").applyInArrow(_grow(shared), "shard long, region int, radius double, trees binary"), "trees"
        )
        radius = {r["region"]: r["radius"] for r in self.trees.groupBy("region").agg(F.max("radius").alias("radius")).collect()}
        self.radii = [radius.get(r, -1.0) for r in range(len(pivots))]
        self.shared = shared

    def _shared(self) -> Callable[[], Space]:
        held = self.spark.sparkContext.broadcast(self.space)
        return lambda: held.value

    def best(self, asked: DataFrame, same: bool, most: int) -> DataFrame:
        """Rows (anchor_id, window, score, vec_id, nth): the ``most`` best rows of every window, nth from 1.

        ``asked`` has vec_id, label, x, low and high (arrays of one length for all anchors).
        """
        slices = max(1, -(-self.n // (EVERY * SLICE)))
        first = self._ask(asked, True, slices, same, most)
        last = first.filter(F.col("nth") == most).select(F.col("anchor_id").alias("vec_id"), "window", "score")
        floors = stored(last.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors")), "floors")
        raised = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("floors", i), v)))
        asked = asked.join(floors, "vec_id", "left").select("vec_id", "label", "x", raised.alias("low"), "high")
        return self._ask(asked, False, slices, same, most)

    def _ask(self, asked: DataFrame, home: bool, slices: int, same: bool, most: int) -> DataFrame:
        sent = asked.mapInArrow(_route(self.shared, self.radii, home, slices), "shard long, slice int, windows int, data binary")
        trees = self.trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "trees")
        found = sent.groupBy("shard", "slice").cogroup(trees.groupBy("shard", "slice")).applyInArrow(
            _answer(self.shared, same, most), "anchor_id long, window int, score long, vec_id long"
        )
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return stored(found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most), "found")


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, vec_id: str = "vec_id",
         vector: str = "embedding", label: str = "label") -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose ids are divisible by ``EVERY``, their positives the best other rows
    of their label. A negative has another label and 50 to 95 per cent of the positive's score.
    Equal scores go by the smaller id. Vectors of different lengths are filled up with zeros.
    Components and scores beyond a 64-bit integer count as the nearest one. An empty table gives no
    rows; other columns are left out.
    """
    index = Index(prepared(embeddings, vec_id, vector, label))
    anchors = stored(index.rows.filter(F.col("vec_id") % EVERY == 0), "anchors")
    open_window = anchors.withColumn("low", F.array(F.lit(LEAST + 1))).withColumn("high", F.array(F.lit(MOST)))
    near = index.best(open_window, True, positives)
    by_window = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("near"))
    # 50 * positive <= 100 * negative <= 95 * positive in whole numbers; below zero there is nothing between
    at = lambda i: F.get("near", F.lit(i))["score"]
    open_at = lambda i: F.coalesce(at(i) >= 0, F.lit(False))
    low = F.array(*[F.when(open_at(i), F.expr(f"near[{i}].score div 2 + near[{i}].score % 2")).otherwise(F.lit(MOST)) for i in range(positives)])
    high = F.array(*[F.when(open_at(i), F.expr(f"near[{i}].score - near[{i}].score div 20 - if(near[{i}].score % 20 > 0, 1, 0)")).otherwise(F.lit(LEAST)) for i in range(positives)])
    windows = anchors.join(by_window.withColumn("low", low).withColumn("high", high), "vec_id").select("vec_id", "label", "x", "low", "high")
    hard = index.best(stored(windows, "windows"), False, negatives)
    positive = near.select("anchor_id", (F.col("nth") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(positive, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % {EVERY} = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT a, b, score FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}
)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= {NEGATIVES}
"""
