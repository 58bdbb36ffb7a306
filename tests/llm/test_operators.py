"""Operators of the training-data subpackage against brute force, on small and awkward tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkprint.llm import bpe, common, decontaminate, jaccard, language, lines, packed, pages, quality, repeats, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, score string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def table(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z") for d, t in rows], DOCS)


def base_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = text(4000)
    first = text(120)
    words = first.split()
    near = " ".join(words[:119] + ["other"])
    passage = text(60)
    blocks = [text(9) for _ in range(12)]
    return [
        (1, first), (2, first), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one two"), (9, "ONE two"), (10, "one  two\n"),
        (11, text(30) + " " + passage + " " + text(30)), (12, text(20) + " " + passage), (13, passage), (14, long), (15, long + " tail"),
        (16, "é" * 100), (17, "x" + "é" * 100), (18, "\n".join(blocks)), (19, "\n".join(["top", *blocks, "end"])), (20, "a\nb\nc"), (21, "a\nb\nc"),
        (22, "aaaa " * 60), (23, "aaaa " * 80), (None, first), (24, "ab" * 40), (24, "ab" * 40), (25, "\n" * 20), (26, "\n" * 20),
    ]


# --- byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, plain):
    rows = base_rows() + [(40, "word1 \n\n word's <|endoftext|> " * 5000), (41, "日本語" * 20000), (42, "a" * 50000), (43, "x\x1c \x85y" * 9000)]
    got = {r["doc_id"]: r for r in bpe.tokenize(table(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for doc, text in rows:
        ids = plain.encode_ordinary(text or "")
        assert list(got[doc]["ids"]) == ids and got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_runs_the_library_cannot_take():
    ranks = open(RANKS, "rb").read()
    for text in (" " * 1_500_000 + "x", "!" * 1_500_000):
        assert bpe.decode(bpe.encode(text, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \n\t'sé!\x1c日", min_size=0, max_size=120))
def test_bpe_cuts_are_safe(text):
    import regex

    whole = regex.findall(public_tokenizers.PATTERN, text)
    for cut in [m.start() for m in bpe._SAFE.finditer(text)]:
        assert regex.findall(public_tokenizers.PATTERN, text[:cut]) + regex.findall(public_tokenizers.PATTERN, text[cut:]) == whole


# --- quality rules ---------------------------------------------------------------------------------


def repeated(words, k=8):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    hit = {j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}
    return len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    assert quality.repeated_words(words) == repeated(words)


def test_quality_figures_and_base_rules(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = base_rows()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"])
                 for r in quality.judge(table(spark, rows), labels).collect())
    expected = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        ls = [x for x in (text or "").split("\n")]
        dup = sum(bool(WORD.search(x)) and x in ls[:i] for i, x in enumerate(ls))
        failed = len(w) < 20 or 100 * repeated(w) > 30 * len(w)
        expected.append((doc or 0, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeated(w), failed, not failed))
    assert got == sorted(expected)
    assert quality.judge(table(spark, []), labels.limit(0)).count() == 0


def test_cutoffs_keep_their_promise():
    assert quality.binomial_tail(3, 40, 0.2) == pytest.approx(sum(math.comb(40, i) * 0.2**i * 0.8 ** (40 - i) for i in range(4)))
    assert quality.binomial_tail(5, 5, 0.1) == 1.0
    few = np.zeros(11, int)
    few[0] = 20
    assert quality.certify(few, few[::-1], 0.01, 0.05) is None  # too few to promise anything
    rng = np.random.default_rng(3)
    broken = 0
    for _ in range(200):
        good = np.bincount(np.minimum(10, rng.geometric(0.45, 2000) - 1), minlength=11)
        bad = np.bincount(rng.integers(4, 11, 300), minlength=11)
        step = quality.certify(good, bad, 0.02, 0.05)
        broken += step is not None and 0.55**step > 0.02
    assert broken <= 20


# --- WARC ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (3, "u", "y"), (3, "u", "y"), (4, "u\r\nWARC-Type: x", None), (5, "u", ""), (None, "u", "x"), (None, None, None), (7, "é", "ü" * 9999)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, shard string")
    kinds, digests = {}, {}
    folder = common.work_folder(spark, "test-warc")
    manifest = warc.write(frame, folder, roll_bytes=300, shard_bytes=1000)
    records = warc.read(spark, folder, with_payload=True).collect()
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows) == len(records)
    for r in records:
        digests.setdefault(r["payload_digest"], set()).add(r["page_id"])
        kinds.setdefault(r["payload_digest"], []).append((r["record_type"], r["page_id"], r["refers_to"]))
    for html, ids in (("x", {1, 2, None}), ("y", {3}), ("", {4, 5, None}), ("ü" * 9999, {7})):
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert digests[digest] == ids
        top = max(i for i in ids if i is not None)
        assert [k for k in kinds[digest] if k[0] == "response"] == [("response", top, None)]
        assert all(k[2] == top for k in kinds[digest] if k[0] == "revisit")
    again = common.work_folder(spark, "test-warc")
    same = lambda m: sorted((r["file"], r["sha256"]) for r in m.collect())
    assert same(warc.write(frame.repartition(3), again, roll_bytes=300, shard_bytes=1000)) == same(manifest)
    assert warc.round_trip(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None, False).replace(b"abc", b"abd"))


# --- toxicity, language ----------------------------------------------------------------------------


def test_toxicity_learns_without_the_held_out(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        w = [rng.choice(["sun", "rain", "house", "tree", "road"]) for _ in range(30)]
        if toxic:
            w[rng.randrange(30)] = "grobian"
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows += [(5000, None), (5001, ""), (None, "tree")]
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["predicted"], t) for i, _, t in marks if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, rows), flipped).collect()} == {k: r["score"] for k, r in got.items()}
    alone = toxicity.score(table(spark, rows[:5]), labels.limit(0)).collect()
    assert [r["score"] for r in alone] == [0.0] * 5
    assert toxicity.score(table(spark, []), labels).count() == 0


def test_language_profiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = language.learn(docs)
    said = language.identify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in said if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ² !"), (4, "日本" * 3000), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, learned).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in learned and got[None] in learned
    assert language.identify(odd, {}).filter("lang_pred != 'und' OR score != 0").count() == 0
    assert language.learn(docs.limit(0)) == {}


# --- near copies, repeats, lines -------------------------------------------------------------------


def linked(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        group = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        out.append((doc or 0, len(sets[i]), (min(group, default=None) if sets[i] else doc) or 0))
    return sorted(out)


def near_copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("size,percent,block", [(3, 90, 1024), (5, 80, 1024), (3, 90, 7)])
def test_jaccard_join(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)  # many blocks per group give the same links
    rows = base_rows() + near_copies()
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in jaccard.join(table(spark, rows), size=size, percent=percent).collect())
    assert got == linked(rows, size, percent)
    assert jaccard.join(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(0, 10_000))
def test_tree_finds_all(n, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 4, (n, 8))
    sizes = points.sum(1) + 1
    tree = jaccard.CountTree(sizes, points)
    for i in range(0, n, 7):
        ok = (sizes * 100 >= 90 * sizes[i]) & (sizes * 90 <= 100 * sizes[i]) & (np.minimum(points, points[i]).sum(1) >= jaccard.needed(sizes[i], sizes))
        assert set(np.flatnonzero(ok)) <= set(tree.near(int(sizes[i]), points[i]))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long"), "long").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def cut_repeats(rows, size=50):
    first = {}
    data = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for doc, b in data:
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], 1 << 62), doc)
    out = []
    for doc, b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < doc:
                mask[i : i + size] = b"\1" * size
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out.append((doc, len(b), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("split", [4096, 1])
def test_repeats(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT_RUNS", split)  # split buckets give the same removals
    rows = base_rows() + near_copies()[:20]
    got = sorted((-(1 << 63) if r[0] is None else r[0], *r[1:]) for r in map(tuple, repeats.remove(table(spark, rows)).collect()))
    assert got == cut_repeats(rows)
    assert repeats.remove(table(spark, [])).count() == 0


def by(tables, name):
    whole = pa.concat_tables([t if isinstance(t, pa.Table) else pa.Table.from_batches([t]) for t in tables])
    return [whole.filter(pc.equal(whole.column(name), v)) for v in sorted(set(whole.column(name).to_pylist()))]


def with_spots(texts):
    number = pa.array(range(len(texts)), pa.int64())
    (rows,) = repeats._with_spots([pa.RecordBatch.from_arrays([number, number, pa.array(texts, pa.binary())], ["row", "ord", "text"])])
    return rows


def with_column(rows, name, values, kind):
    """The rows that have a value, with it."""
    at = [i for i, v in enumerate(values) if v]
    return rows.take(pa.array(at, pa.int64())).append_column(name, pa.array([values[i] for i in at], kind))


def judged_runs(rows, buckets):
    told = [packed.tell_shared(buckets)(t) for t in by(repeats._sample_sender(buckets)([rows]), "bucket")]
    shared = [None] * rows.num_rows
    for t in by(told, "row"):
        for owner in packed.per_owner(t).to_pylist():
            shared[owner["row"]] = owner["data"]
    sent = repeats._run_sender(buckets, 3)([with_column(rows, "shared", shared, pa.binary())])
    return [r for t in by([repeats._judged(t, 3) for t in by(sent, "bucket")], "row") for r in repeats._per_text(t).to_pylist()]


def removed_here(texts, buckets=2):
    """What the steps of the operator remove from different texts, in this process."""
    rows, n = with_spots(texts), len(texts)
    said = {kind: [[] for _ in range(n)] for kind in (repeats.REMOVED, repeats.OPEN, repeats.PLACES)}
    for r in judged_runs(rows, buckets):
        said[r["kind"]][r["row"]].append(r["data"])
    sent = list(repeats._suffix_sender(buckets)([with_column(rows, "opened", said[repeats.OPEN], pa.list_(pa.binary()))]))
    for t in by(sent, "bucket"):
        for r in repeats._suffix_judge(t).to_pylist():
            said[repeats.PLACES][r["row"]].append(r["data"])
    for name, kind in (("classes", repeats.REMOVED), ("places", repeats.PLACES)):
        rows = rows.append_column(name, pa.array(said[kind], pa.list_(pa.binary())))
    return [tuple(r.values()) for batch in repeats._cut([rows]) for r in batch.to_pylist()]


@pytest.mark.parametrize("split,seed", [(4096, 1), (1, 2), (2, 3), (3, 4)])
def test_repeats_in_odd_texts(monkeypatch, split, seed):
    monkeypatch.setattr(repeats, "SPLIT_RUNS", split)
    monkeypatch.setattr(repeats, "STEP", 64)  # runs over the borders of steps are whole
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)
    rng = random.Random(seed)
    some = lambda n, letters="abcdefghijklmnop": "".join(rng.choice(letters) for _ in range(n))
    passages = [some(n) for n in (20, 43, 49, 50, 51, 57, 58, 81, 200)] + ["é" * 30, "a" * 70, "ab" * 40, "abcab" * 20]
    texts = ["a" * 200, "ab" * 90, "abcab" * 50, "a" * 50, "b" + "a" * 49, "é" * 100, *(some(150, "ab") for _ in range(12))]
    for _ in range(40):
        picked = [rng.choice(passages) for _ in range(4)]
        texts.append("".join(some(rng.choice((0, 1, 7, 30, 60))) + p[rng.choice((0, 0, 3)) :] for p in picked))
    texts = sorted({t for t in texts + passages if len(t.encode()) >= 50}, key=lambda t: hashlib.md5(t.encode()).digest())
    expected = [(doc, *r) for doc, _, *r in cut_repeats(list(enumerate(texts)))]
    assert removed_here([t.encode() for t in texts]) == expected


@pytest.mark.parametrize("common,sorts", [(40, False), (60, True)])
def test_runs_without_a_common_suffix_are_not_sorted(common, sorts):
    rng = random.Random(common)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passages = [some(common) for _ in range(50)]
    texts = [("".join(some(60) + p for p in passages) + some(60)).encode() for _ in range(4)]
    said = judged_runs(with_spots(texts), 1)
    assert any(r["kind"] == repeats.OPEN for r in said) == sorts


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_ranks_order_suffixes(data):
    codes = np.frombuffer(bytes(b % 3 for b in data), np.uint8)
    text = codes.tobytes() + b"\0" * 50
    rank = repeats.sort_ranks(codes)
    full = range(max(0, len(codes) - 50))
    for i in full:
        for j in list(full)[:: max(1, len(full) // 7)]:
            assert (rank[i] < rank[j]) == (text[i : i + 50] < text[j : j + 50])


def chunks_of(text):
    ls = (text or "").split("\n")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    h = [md5(x) for x in ls]
    r = [md5(h[i] + (h[i + 1] if i + 1 < len(h) else "")) for i in range(len(h))]
    starts = [0] + [i for i in range(1, len(ls) - 1) if r[i] < r[i - 1] and r[i] <= r[i + 1]]
    return [ls[a:b] for a, b in zip(starts, [*starts[1:], len(ls)])]


def without_repeats(rows):
    """By brute force: (doc, text, n_lines, n_removed) per row."""
    key = lambda r: (-1 if r[0] is None else r[0], hashlib.md5(f"{'' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).hexdigest())
    owner, spans, seen = {}, {}, {}
    for r in sorted(set(rows), key=key):
        for no, c in enumerate(chunks_of(r[1])):
            owner.setdefault("\n".join(c), (key(r), no))
        ls = (r[1] or "").split("\n")
        said = [i for i, x in enumerate(ls) if WORD.search(x)]
        n = [len(WORD.findall(ls[i])) for i in said]
        ahead = [next(((a, b) for b in range(a, len(said)) if sum(n[a : b + 1]) > 50), None) for a in range(len(said))]
        behind = [next(((a, b) for a in range(b, -1, -1) if sum(n[a : b + 1]) > 50), None) for b in range(len(said))]
        for a, b in sorted({x for x in ahead + behind if x}):
            body = "\n".join(ls[i] for i in said[a : b + 1])
            spans.setdefault(key(r), []).append((body, said[a], said[b]))
            seen.setdefault(body, []).append((key(r), said[a]))
    out = []
    for r in rows:
        ls, gone, taken, firsts, at = (r[1] or "").split("\n"), set(), set(), set(), 0
        for no, c in enumerate(chunks_of(r[1])):
            if len(c) > 1 and WORD.search("\n".join(c)) and owner["\n".join(c)] != (key(r), no):
                gone |= set(range(at, at + len(c)))
            at += len(c)
        for body, a, b in spans.get(key(r), []):
            if len(seen[body]) > 1:
                (firsts if min(seen[body]) == (key(r), a) else taken).update(range(a, b + 1))
        gone |= taken - firsts
        left = [x for i, x in enumerate(ls) if i not in gone]
        if gone and not any(map(WORD.search, left)):
            left, gone = [], ls
        out.append((r[0], None if r[1] is None else "\n".join(left), len(ls), len(gone)))
    return out


def line_cases():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, planted, doc = [], [], 100
    for n_lines in (1, 2, 3, 5, 8, 20):
        for _ in range(4):
            passage = [line(rng.randint(60 // n_lines + 1, 90 // n_lines + 2)) for _ in range(n_lines)]
            for copy in range(3):
                rows.append((doc, "\n".join([line(9) for _ in range(rng.randint(1, 6))] + passage + [line(7) for _ in range(rng.randint(1, 6))])))
                planted += [(doc, passage)] if copy else []
                doc += 1
    long = line(60)
    rows += [(1, long + "\nx y\nz"), (2, "other\n" + long + "\nx y"), (3, long), (4, long + "\n\n" + long), (5, f"{line(3)}\n{long}\n{line(4)}")]
    return rows, planted


def test_line_dedup(spark):
    cases, planted = line_cases()
    for rows in (base_rows(), cases):
        got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup(table(spark, rows)).collect()]
        assert sorted(got, key=str) == sorted(without_repeats(rows), key=str)
        assert any(r[3] for r in got)
    left = {r[0]: r[1].split("\n") for r in got}
    assert not any(set(passage) & set(left[doc]) for doc, passage in planted)  # recall 1 over 1 to 20 lines
    assert lines.dedup(table(spark, []), keep=("n_lines", "lang")).columns == ["doc_id", "text", "n_lines", "n_removed", "lang"]
    assert lines.dedup(table(spark, [])).count() == 0
    plan = lines.dedup(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- decontamination -------------------------------------------------------------------------------


def leaks(rows, items):
    out = {}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}
    weight = lambda s: sum(len(" ".join(x)) for x in s)
    for doc, text in rows:
        w = words_of(text)
        for item, body in items:
            v = words_of(body)
            if not w or not v:
                continue
            for start in range(max(1, len(w) - len(v) + 1)):
                a, b = shingles(w[start : start + len(v)]), shingles(v)
                if a & b and 100 * weight(a & b) >= 80 * weight(a | b):
                    best = (-weight(a & b) / weight(a | b), start)
                    out[doc, item] = min(out.get((doc, item), best), best)
    return {(d, i, s, round(-x, 6)) for (d, i), (x, s) in out.items()}


def test_decontamination(spark):
    rows = [r for r in base_rows() if r[1] is None or len(r[1]) < 5000]
    passage = dict(rows)[13]
    edge = " ".join(passage.split()[:-1] + ["changed"])
    items = [(1, passage), (2, passage.upper()), (3, edge), (4, None), (5, ""), (6, "one"), (8, "ONE Two"), (9, " ".join(passage.split()[3:6])), (10, " ".join(passage.split()[7:11])), (7, "nothing that occurs anywhere in these texts at all"), (None, passage)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n string")
    found = decontaminate.find(table(spark, rows), frame)
    got = {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in found.collect()}
    assert got == leaks(rows, items)
    assert {(d, i) for d, i, _, _ in got} >= {(11, 1), (12, 1), (13, 2), (12, 3), (7, 6), (8, 6), (10, 8), (11, 9), (13, 9), (12, 10)}
    assert decontaminate.find(table(spark, []), frame).count() == 0
    assert decontaminate.find(table(spark, rows), frame.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())


# --- pages -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<b>b</b>&nbsp;c&amp;<br>d", "ab c& d"),
    ("<nav>menu</nav><article><header><h1>T</h1></header><p>One two.<p>Three</article><footer>f</footer>", "T One two. Three"),
    ("<body><div class='cookie-notice'>x</div><main><p>Long text of the page here.</p><aside>side</aside></main><div id=comments><p>zz</div>",
     "Long text of the page here."),
    ("<article><p>real text</p><div class=ad>buy</div><form>f<input></form><script>var a='<p>';</script></article><article class=comment>no</article>", "real text"),
    ("<nav>menu</nav><form id=all><h1>T</h1><p>Long text of the page here.</p><p>More of it.</p></form><footer>f</footer>", "T Long text of the page here. More of it."),
    ("<section id=search><article><h1>T</h1><p>Long text of the page here.</p></article></section><form>Your name<input></form>", "T Long text of the page here."),
    ("<div class='banner-box'><div>Buy now</div></div><div class=widget><p>Long text of the page here, and on.</p><form>Ask</form></div>", "Long text of the page here, and on."),
    ("<article><p>One.</p><p class=share-price>It rose by two.</p><div class='share-buttons'>x y</div></article>", "One. It rose by two."),
    ("<article><h1>T</h1><p>Short article text.</p></article><section><article><p>" + "I think so. " * 30 + "</p></article><article><p>Me too, and more.</p></article></section>",
     "T Short article text."),
    ("<main><article><h2>T</h2><p>Article text.</p><section><article>" + "I think so. " * 30 + "</article></section></article></main>", "T Article text."),
    ("<body><div><h1>T</h1><p>Text of the page, long enough to see.</p></div><section><h3>12 Comments</h3><p>" + "I think so. " * 30 + "</p></section>",
     "T Text of the page, long enough to see."),
    ("<article><h1>A</h1><p>First text.</p></article><section><article><h2>B</h2><p>Second text.</p></article></section>", "A First text. B Second text."),
    ("<article><p>First text.</p></article><article><p>Second text.</p></article><article><p>Third text.</p></article>", "First text. Second text. Third text."),
    ("<article><h1>T</h1><p>Text of it.</p></article><div class=sidebar><p>" + "Other things to read. " * 20 + "</p></div>", "T Text of it."),
    ("<div" * 3, "<div<div<div"), ("<p>" + "w " * 30000 + "</p>", ("w " * 30000).strip()),
])
def test_main_text(page, text):
    assert pages.main_text(page or "") == text


def test_pages_of_the_tables(spark, sf_dir):
    import html

    table_ = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(table_).collect()}
    for r in table_.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        plain_text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", "\n", article))).split())
        assert got[r["page_id"]] == (plain_text, len(plain_text))
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, pages.extract(odd).collect()), key=str) == [(1, "u", "", 0), (None, None, "", 0)]
