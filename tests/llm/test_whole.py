"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from inkprint.llm import language, lines, pages

# --- languages -------------------------------------------------------------------------------------


def test_rare_language_is_learned(spark):
    letters = F.expr("transform(sequence(1, 30), i -> substring(if(id % 50000 = 7, 'xyzwvuq', 'abcdefg'), 1 + cast(pmod(xxhash64(id, i), 7) as int), 1))")
    docs = spark.range(200_000).select(
        F.col("id").alias("doc_id"), F.array_join(letters, "").alias("text"), F.expr("if(id % 50000 = 7, 'rare', 'common')").alias("lang")
    )
    learned = language.learn(docs)
    assert set(learned) == {"common", "rare"}
    rare = language.identify(docs.filter("lang = 'rare'"), learned)
    assert [r["lang_pred"] for r in rare.collect()] == ["rare"] * 4


def test_shares_of_languages():
    assert language.share_of([], 20_000, 1_000) == 1_000
    assert language.share_of([5, 9], 20_000, 0) == 9
    assert language.share_of([50_000_000, 1_000], 20_000, 1_000) == 19_000
    assert language.share_of([10_000_000] * 4, 20_000, 1_000) == 5_000
    assert language.share_of([10_000] * 2_000, 20_000, 1_000) == 1_000


# --- pages -----------------------------------------------------------------------------------------


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_pages_without_article_keep_all_parts():
    rng = random.Random(3)
    lead, more, body = sentence(rng, 30), [sentence(rng, 30)], [sentence(rng, 30) for _ in range(9)]
    menu = "".join(f"<div><a href=x>go{i}</a> <a href=y>to</a></div>" for i in range(20))
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    page = f"<body>{menu}<div><h1>Title</h1><p>{lead}</p><div class=body>{p(body)}</div><div class=more>{p(more)}</div></div>{menu}</body>"
    assert pages.main_text(page) == " ".join(["Title", lead, *body, *more])


def test_pages_with_several_articles():
    rng = random.Random(4)
    a, b, c = (sentence(rng, n) for n in (60, 40, 5))
    menu = "<div>" + "<a href=x>go</a> " * 30 + "</div>"
    page = f"<body>{menu}<article><p>{a}</article><article><p>{b}</article><article class='related'><p>{b}</article><article><p>{c}</article></body>"
    assert pages.main_text(page) == f"{a} {b} {c}"
    apart = f"<body>{menu}<div><article><p>{a}</article></div><div><article><p>{b}</article></div></body>"
    assert pages.main_text(apart) == f"{a} {b}"
    assert pages.main_text(f"<main>{menu}<article><p>{a}</article><article><p>{b}</article></main>").endswith(f"{a} {b}")


# --- lines -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", range(1, 11))
def test_repeated_passages_go_whole(spark, sf_dir, n):
    rng = random.Random(n)
    fresh = lambda k: [sentence(rng, 7) for _ in range(k)]
    passage = [sentence(rng, 60 // n + 1) for _ in range(n)]
    around = [(fresh(3), fresh(4)) for _ in range(3)] + [([], fresh(2)), (fresh(2), [])]
    rows = [(i, "\n".join([*a, *passage, *b]), "en", "s", 0) for i, (a, b) in enumerate(around)]
    expected = [rows[0][1], *("\n".join([*a, *b]) for a, b in around[1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == expected


def test_passages_keep_one_copy(spark):
    line = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    a, b, c, d = line
    rows = [(1, "\n".join([a, b, c])), (2, "\n".join([b, "", c, d])), (3, "\n".join([c, d])), (4, "\n".join([a] * 6)),
            (5, "\n".join(["", a, b, " "])), (6, "a\nb"), (6, "a\nb"), (None, None), (7, "\n".join([a, b])), (7, "\n".join([a, b]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_removed"]) for r in lines.passages(frame).collect()), key=str)
    assert got == sorted([
        (1, rows[0][1], 3, 0), (2, "\n".join([c, d]), 4, 2), (3, "", 2, 2), (4, "\n".join([a] * 2), 6, 4), (5, "", 4, 4),
        (6, "a\nb", 2, 0), (6, "a\nb", 2, 0), (0, None, 1, 0), (7, "", 2, 2), (7, "", 2, 2),
    ], key=str)
