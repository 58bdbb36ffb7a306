"""The conversation trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkprint.llm import trie

TURNS = "conv_id long, turn long, role string, text string, key string, depth string, turns string"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def plain_nodes(built):
    """Every prefix of every conversation {id: [(role, text)]}, by the words of the contract."""
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += children[p] == 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(((c, (t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c is not None)):
        own[c].append((role, text))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    return built


def got(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.select(*trie.NODE).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", "t") for r in rows], TURNS)


@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=24), st.lists(st.integers(1, 23), max_size=6))
@settings(max_examples=150, deadline=None)
def test_forests_merge_across_boundaries(sequences, cuts):
    """Any cut of the sorted sequences into partitions, merged two at a time, gives the same nodes."""
    built = {c: [("r", "x" * (v + 1)) for v in s] for c, s in enumerate(sequences)}
    groups = defaultdict(list)
    for c, s in enumerate(sequences):
        groups[tuple(s)].append(c)
    paths = [
        trie.Path([bytes([v]) for v in s], [v + 1 for v in s], [trie.Extra(len(s), len(ids), min(ids), 0, 0, 0, sha(ids))])
        for s, ids in sorted(groups.items())
    ]
    bounds = sorted({0, len(paths), *(c for c in cuts if c < len(paths))})
    level, rows = [paths[a:b] for a, b in zip(bounds, bounds[1:])], []
    level = [(p, False) for p in level]
    while True:
        left, whole = [], len(level) == 1 and level[0][1]
        for part, keyed in level:
            left.append([])
            rows += list(trie.forest(part, whole, keyed, left[-1]))
        if whole:
            break
        level = [([*a, *b], True) for a, b in zip(left[::2], [*left[1::2], []])]
    by_key = {r[8]: r[1] for r in rows if r[8] is not None}
    nodes = sorted((r[1], r[0], r[2] if r[2] is not None else by_key.get(r[9], -1), *r[3:8]) for r in rows)
    assert nodes == plain_nodes(built)


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "é", "", None, "long " * 50])) for c in range(-12, 60) for t in range(rng.randint(0, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 190) for t in range(3)]  # a group of copies with most rows
    rows += [(200, t, "user", f"turn {t}") for t in range(150)] + [(201, t, "user", f"turn {t}") for t in range(150)]  # very long
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (300, None, "b", "y"), (300, None, "a", "z"), (300, 0, "a", "z"), (300, 0, "a", "z"), (301, 5, None, None)]
    rng.shuffle(rows)
    frame = table(spark, rows).repartition(7)
    assert got(trie.trie(frame)) == plain_nodes(plain_rebuilt(rows))
    assert trie.trie(frame.limit(0)).count() == 0
    one = [(7, 0, None, None)]
    assert got(trie.trie(table(spark, one))) == plain_nodes(plain_rebuilt(one))


@pytest.mark.parametrize("parts,merged", [(9, 2), (5, 64), (1, 64)])
def test_many_partitions(spark, monkeypatch, parts, merged):
    monkeypatch.setattr(trie, "MERGED", merged)
    rng = random.Random(parts)
    rows = [(c, t, "r", rng.choice("ab")) for c in range(400) for t in range(rng.randint(1, 7))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert got(trie.trie(table(spark, rows))) == plain_nodes(plain_rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_order_columns_of_any_type(spark):
    frame = spark.createDataFrame([(1, "b", "r", "second"), (1, "a", "r", "first"), (1, None, "r", "zero")], "c long, at string, who string, said string")
    rows = trie.sequences(frame, "c", "at", "who", "said").collect()
    assert [t["size"] for t in rows[0]["turns"]] == [4, 5, 6]
