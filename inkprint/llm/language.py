"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters: the first one
shifted twice, the second once, multiplied element by element. A text is the sum of its trigrams'
vectors, a language the sum of its texts, and a text is given the language with the largest cosine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import split_of

SIZE = 512
SEED = 20261
TRAIN_ROWS = 20_000  # so many labelled documents are shared out evenly among the languages, all of those of rare ones
LEAST_ROWS = 1_000  # with very many languages each still gets about so many, or all it has
MAX_LANGUAGES = 2000  # prototypes go to every task, so their number is checked
_CACHE = 60_000  # trigram vectors held at a time
_GAPS = regex.compile(r"\P{L}+")  # any run of characters that are no letters counts as one blank


class Profiles:
    """Vectors of texts; trigram vectors are made once and kept while there is room."""

    def __init__(self, size: int = SIZE, seed: int = SEED) -> None:
        self.size, self.seed = size, seed
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        """``known`` trigrams in order, the rows of ``vectors`` that are theirs; rows are taken one after the other."""
        self.known, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.zeros((1024, self.size), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.size)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def _bind(self, grams: np.ndarray) -> np.ndarray:
        codes = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF])
        distinct, at = np.unique(codes, return_inverse=True)
        table = np.stack([self.letter(int(c)) for c in distinct])
        at = at.reshape(codes.shape)
        return np.roll(table, 2, axis=1)[at[0]] * np.roll(table, 1, axis=1)[at[1]] * table[at[2]]

    def vector(self, text: str) -> np.ndarray | None:
        """The bundle of a text's trigrams; None without a letter."""
        folded = _GAPS.sub(" ", text.lower()).strip(" ")
        if not folded:
            return None
        codes = np.frombuffer(f" {folded} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        grams, counts = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        total = np.zeros(self.size, np.float32)
        for start in range(0, len(grams), _CACHE):  # one pass but for texts with very many different trigrams
            part, weight = grams[start : start + _CACHE], counts[start : start + _CACHE].astype(np.float32)
            total += weight @ self._rows(part)
        return total

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of different trigrams in order, at most ``_CACHE``."""
        missing = self._missing(grams)
        if len(self.known) + len(missing) > _CACHE:
            self._forget()
            missing = grams
        if len(missing):
            held = len(self.known)
            if held + len(missing) > len(self.vectors):
                wider = np.zeros((min(_CACHE, max(2 * len(self.vectors), held + len(missing))), self.size), np.float32)
                wider[:held] = self.vectors[:held]
                self.vectors = wider
            self.vectors[held : held + len(missing)] = self._bind(missing)
            before = np.searchsorted(self.known, missing)
            self.known = np.insert(self.known, before, missing)
            self.place = np.insert(self.place, before, np.arange(held, held + len(missing)))
        return self.vectors[self.place[np.searchsorted(self.known, grams)]]

    def _missing(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return grams
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return grams[self.known[at] != grams]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-12)


def share_of(counts: list[int], rows: int, least: int) -> int:
    """The most rows any language may give so that all together give ``rows``; ``least`` at the least."""
    left, share = rows, rows
    for done, n in enumerate(sorted(counts)):
        share = left // (len(counts) - done)
        if n > share:
            break
        left -= n
    else:
        share = max(counts, default=0)
    return max(share, least)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          rows: int = TRAIN_ROWS, folds: int = 5, held_out: int = 0, least: int = LEAST_ROWS) -> dict[str, np.ndarray]:
    """Prototype of each language, from a bounded sample of the labelled documents outside the hold-out.

    Languages are counted first: one with no more rows than its share gives all of them, others give
    about their share. The sample is taken by a hash of the id, so it is the same in every run. Each
    text counts by its direction, not its length. Sums combine per task and then per language.
    """
    fold = split_of(F.col(doc_id), folds)
    usable = docs.filter((fold >= 0) & (fold != held_out) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    named = F.col(lang).cast("string")
    counted = usable.groupBy(named.alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = share_of([r["n"] for r in counted], rows, least)
    parts = json.dumps({r["lang"]: int(share / r["n"] * (1 << 30)) for r in counted if r["n"] > share})
    part = F.coalesce(F.element_at(F.from_json(F.lit(parts), "map<string,bigint>"), named), F.lit(1 << 30))
    sample = usable.filter(F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < part)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(), {}
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (v := profiles.vector(value.as_py())) is not None:
                    sums[language] = sums.get(language, 0) + _unit(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([s.astype(float) for s in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
        )

    parts = sample.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(bundle, "lang string, v array<double>")
    summed = (
        parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    )
    return {r["lang"]: _unit(np.array([x["x"] for x in r["v"]])) for r in summed.collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text",
             folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine, not below 0).

    Null texts, texts without a letter, and any text where no language was learned give ``und``
    and 0. Equal cosines go to the language first by name. Repeated rows give a row each. No shuffle.
    """
    names = sorted(prototypes)
    table = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, SIZE), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            said, scores = [], []
            for value in batch.column(2):
                v = profiles.vector(value.as_py()) if names and value.is_valid else None
                cosines = table @ _unit(v) if v is not None else None
                best = int(cosines.argmax()) if cosines is not None else -1
                said.append(names[best] if best >= 0 else "und")
                scores.append(min(1.0, max(0.0, float(cosines[best]))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (split_of(F.col(doc_id), folds) == held_out).alias("held_out"), F.col(text).alias("text")
    )
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
