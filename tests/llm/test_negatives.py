"""Hard negatives and cover trees against plain loops over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkprint.llm import negatives as ng

ROWS = "vec_id long, embedding array<float>, label int, region string, x string, score string"


def plain(rows, every=50):
    """By the words of the contract; rows (vec_id, vector, label)."""
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    found = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scores = sorted((-dot(v, w), b, l) for b, (l, w) in held.items() if b != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            fit = [(n, t) for t, n, l in scores if l != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            found += [(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(fit, 1)]
    return sorted(found)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "r", "x", "s") for r in rows], ROWS).repartition(4)
    return sorted(map(tuple, ng.mine(frame).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clustered(rng, n, dims, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    vectors = [[x + rng.gauss(0, spread) for x in rng.choice(centres)] for _ in range(n)]
    return [[x / math.hypot(*v) for x in v] for v in vectors]


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(ng, "CELLS", 600)  # many regions, many shards
    rng = random.Random(3)
    rows = [(i, v, rng.choice([0, 1, 2, 9])) for i, v in enumerate(clustered(rng, 700, 6, 0.3))]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0], 3) for i in range(300)]  # a third are the same vector
    rows += [(2000, None, 1), (2050, [0.1, None], 1), (2100, [0.1, float("nan")], 1), (2150, [float("inf"), 1.0], 2), (2200, [0.4] * 6, None), (None, [0.4] * 6, 1)]
    rows += [(2250, [], 1), (2300, [0.5, 0.25], 1), (2350, [0.0] * 6, 2), (2400, [-0.5] * 6, 1), (2450, [9.0] * 6, 4), (2450, [9.0] * 6, 4), (2500, [1.0], 5), (2500, [2.0], 3)]
    assert got(spark, rows) == plain(rows)


def test_small_tables(spark):
    assert got(spark, [(0, [1.0, 0.5], 1)]) == []
    frame = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert ng.mine(frame.limit(0)).count() == 0
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.9, 0.1], 2), (50, [0.8, 0.0], 2), (3, [0.6, 0.0], 3)]
    assert got(spark, rows) == plain(rows) != []


def space_of(x):
    square = float((x.astype(float) ** 2).sum(1).max())
    return ng.Space(x.shape[1], square, x[:1], [1])


@given(st.integers(0, 10_000), st.sampled_from([0.0, 0.05, 0.5]), st.booleans(), st.booleans())
@settings(max_examples=60, deadline=None)
def test_search_is_exact(seed, spread, same, huge):
    rng = random.Random(seed)
    n = rng.randint(1, 300)
    x = np.floor(np.array(clustered(rng, n, 4, spread)) * 256).astype(np.int64) * (10**7 if huge else 1)
    ids, labels = np.array(rng.sample(range(1000), n)), np.array([rng.randint(0, 2) for _ in range(n)])
    space = space_of(x)
    assert (space.kind is object) == huge
    trees = ng.Trees.unpacked(ng.Trees.over(ids, labels, x, space).packed())
    q = np.arange(min(n, 9))
    scale = int(space.square)
    low = np.array([[rng.randint(-scale, scale), ng.LEAST + 1] for _ in q])
    high = np.array([[lo + rng.randint(0, scale), ng.MOST] for lo, _ in low.tolist()])
    answer = ng.Search(trees, ng.Asked(ids[q], labels[q], x[q], low, high), space, same, 3).rows()
    expected = []
    for k in q:
        for w in range(2):
            fit = sorted((-int(x[k].astype(object) @ x[j].astype(object)), int(ids[j])) for j in range(n)
                         if ((labels[j] == labels[k]) and j != k if same else labels[j] != labels[k]))
            expected += [(int(ids[k]), w, -s, i) for s, i in [f for f in fit if low[k, w] <= -f[0] <= high[k, w]][:3]]
    assert sorted(zip(*(c.tolist() for c in answer))) == sorted(expected)


def test_cover_tree_covers_and_skips():
    rng = random.Random(8)
    x = np.floor(np.array(clustered(rng, 3000, 8, 0.02)) * 256).astype(np.int64)
    space, ids = space_of(x), np.arange(3000)
    trees = ng.Trees.over(ids, ids % 3, x, space)
    assert sorted(trees.ids.tolist()) == ids.tolist() and len(trees.roots) == 2
    lifted = space.lift(trees.x)
    for centre, radius, first, end, child, last in trees.nodes:
        rows = lifted[int(first) : int(end)]
        assert np.sqrt(((rows - lifted[int(centre)]) ** 2).sum(1)).max() <= radius + space.slack
        if last:
            spans = [tuple(map(int, n[2:4])) for n in trees.nodes[int(child) : int(last)]]
            assert spans[0][0] == first and spans[-1][1] == end and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    asked = ng.Asked(ids[:50], ids[:50] % 3, x[:50], np.full((50, 1), ng.LEAST + 1), np.full((50, 1), ng.MOST))
    assert ng.Search(trees, asked, space, True, 5).rows_seen < 0.6 * 50 * 3000


@pytest.mark.parametrize("positive", [0, 1, 19, 20, 21, 99, 100, 12345])
def test_windows_in_whole_numbers(spark, positive):
    v = spark.sql(f"SELECT {positive}L div 2 + {positive}L % 2, {positive}L - {positive}L div 20 - if({positive}L % 20 > 0, 1, 0)").first()
    assert tuple(v) == (-(-50 * positive // 100), 95 * positive // 100)
