"""Packing against a plain best-two-fit, one sequence after the other, and against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkprint.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
WORDS = "doc_id long, text string, piece string, length string, part string, sequence_id string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def plain_fill(free, size):
    """One sequence by the words of the method, with loops over all pieces and all pairs; takes them out of ``free``."""
    taken, gap = [], size
    while fits := [n for n in free if n <= gap]:
        taken.append(max(fits))
        free.remove(taken[-1])
        gap -= taken[-1]
    if gap and taken:
        smallest = min(taken)
        pairs = [(a + b, a, b) for i, a in enumerate(free) for j, b in enumerate(free) if i < j and a + b <= gap + smallest]
        total, a, b = max(((t, max(a, b), min(a, b)) for t, a, b in pairs), default=(0, 0, 0))
        if total > smallest:
            taken.remove(smallest)
            free.append(smallest)
            for n in (a, b):
                free.remove(n)
                taken.append(n)
    return tuple(sorted(taken, reverse=True))


def plain_pack(lengths, size):
    free, made = list(lengths), []
    while free:
        made.append(plain_fill(free, size))
    return sorted(made)


def expanded(lengths, size):
    """The sequences of the plan; checks that offsets have no gaps and numbers begin at 0."""
    made, slots = {}, packing.plan(Counter(lengths), size)
    for n, k in Counter(lengths).items():
        own = [s for s in slots if s.length == n]
        for rank in range(k):
            slot = [s for s in own if s.rank <= rank][-1]
            nth = rank - slot.rank
            made.setdefault(slot.sequence + nth // slot.each, []).append((slot.offset + nth % slot.each * n, n))
    for places in made.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])][: len(places)] and sum(n for _, n in places) <= size
    assert sorted(made) == list(range(len(made)))
    return sorted(tuple(n for _, n in places) for places in made.values())


@given(st.integers(4, 40).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=60))))
@settings(max_examples=100, deadline=None)
def test_plan_is_best_two_fit(case):
    size, lengths = case
    assert expanded(lengths, size) == plain_pack(lengths, size)


def test_plan_of_large_counts_is_repeated():
    few = {n: 65 - n for n in range(1, 65)}  # short pieces enough to fill what long ones leave
    many = {n: k * 10**12 for n, k in few.items()}
    slots = packing.plan(many, 64)
    assert len(slots) < 2000
    tokens = sum(n * k for n, k in many.items())
    used = max(s.sequence for s in slots) + 1
    assert used <= 1.001 * tokens / 64 + 2


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=8))
@settings(max_examples=100, deadline=None)
def test_ids_of_words(tokenizer, parts):
    words = packing.WordIds(open(FILE).read())
    for text in (" ".join(parts), "".join(parts), "\n".join(p + "'ll" for p in parts)):
        assert words.of(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", [
    "<|endoftext|> a<|startoftext|>b", "it's DON'T I'LL x'", "É́ÀÇ ß Ŝ x\x1cy\x85z q ² 3½ 你好 éa", "!!??a9b12,,--", "a​b İI ſ Σς ÿŸ", "x" * 5000, "á " * 3000,
])
def test_ids_of_awkward_words(tokenizer, text):
    words = packing.WordIds(open(FILE).read())
    for _ in range(2):  # unknown, then remembered
        assert words.of(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, docs, tokenizer, size):
    by_doc = Counter()
    places = {}
    for r in rows:
        by_doc[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    expected = Counter()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), size)):
            expected[d, piece, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes())] += 1
    assert by_doc == expected
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [0, *np.cumsum([n for _, n in p])][: len(p)] and sum(n for _, n in p) <= size
    assert sorted(tuple(sorted((n for _, n in p), reverse=True)) [::1] for p in places.values()) == plain_pack([r["length"] for r in rows], size)


def test_awkward_table(spark, tokenizer):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["one", "Two,", "drei", "quatre!", "été"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (None, text(9)), (103, text(9000)), (104, "x"), (104, "x")]
    docs += [(200 + i, "same words here") for i in range(90)]  # a length that more than a third of the pieces have
    frame = spark.createDataFrame([(d, t, "p", "l", "q", "s") for d, t in docs], WORDS).repartition(5)
    rows = packing.sequences(frame, FILE, size=64, with_ids=True).collect()
    check(rows, docs, tokenizer, 64)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    assert packing.sequences(frame.limit(0), FILE).count() == 0
    with pytest.raises(ValueError):
        packing.sequences(frame, public_tokenizers.path("byte_bpe_50k.json"))


def test_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.sequences(docs, FILE).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 2048)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1
