"""Best-two-fit packing of token pieces into sequences of a fixed size.

How many pieces there are of each length is all that a packing plan needs, and there are at most
``size`` lengths. So Spark counts the lengths, the driver makes the plan from at most ``size``
counts whatever the number of documents, and every piece finds its place in the plan by its rank
among the pieces of its length.

The plan is the one of best-two-fit over pieces from long to short. A sequence takes the longest
piece left, then again and again the longest one that fits. If a gap stays, its smallest piece gives
way to the two pieces that together fill the wider gap most tightly, if they fill more of it. A
sequence so filled is repeated while its pieces last, which gives what one sequence after the other
would give.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import stored

SIZE = 2048  # tokens of a sequence
END = 0  # the id that ends a document
WORDS_KEPT = 1 << 18  # words whose ids a task remembers
LONGEST_KEPT = 48  # bytes of such a word
ROWS_OUT = 4096  # rows of a record batch that a task gives out
MAX_TOKENIZER_BYTES = 64 << 20  # the tokenizer file is sent to every executor, so its size is checked


class Slots(NamedTuple):
    """Places for the pieces of one length whose ranks begin at ``rank``: ``each`` in every sequence from ``sequence`` on."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def fill(left: np.ndarray) -> list[int]:
    """The lengths, from long to short, that best-two-fit puts into the next sequence.

    ``left[n]`` pieces of length n are unpacked; the sequence holds ``len(left) - 1`` tokens.
    """
    taken: Counter[int] = Counter()
    gap = len(left) - 1
    lengths = np.flatnonzero(left)

    def longest(most: int) -> int:
        """The longest piece left of at most ``most`` tokens; 0 if there is none."""
        for at in range(int(np.searchsorted(lengths, most, "right")) - 1, -1, -1):
            if left[lengths[at]] > taken[int(lengths[at])]:
                return int(lengths[at])
        return 0

    while n := longest(gap):
        taken[n] += 1
        gap -= n
    if gap and taken:
        smallest = min(taken)
        room = gap + smallest
        free = left.copy()
        for n, k in taken.items():
            free[n] -= k
        best = (smallest, 0, 0)
        # the longest free piece of at most each length; a pair may take one length twice
        sizes = np.arange(len(left))
        upto = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        first = np.flatnonzero(free[: room + 1] > 0)
        if len(first):
            second = upto[np.minimum(room - first, first)]
            alone = (second == first) & (free[first] < 2)
            second = np.where(alone, upto[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            at = len(total) - 1 - int(np.argmax(total[::-1]))  # of equal sums the one with the longest piece
            best = max(best, (int(total[at]), int(first[at]), int(second[at])), key=lambda x: x[0])
        if best[1]:
            taken[smallest] -= 1
            taken[best[1]] += 1
            taken[best[2]] += 1
    return sorted(taken.elements(), reverse=True)


def plan(counts: dict[int, int], size: int = SIZE) -> list[Slots]:
    """Where the pieces go, given how many there are of each length (1 to ``size``)."""
    left = np.zeros(size + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    given = np.zeros(size + 1, np.int64)
    slots: list[Slots] = []
    sequence = 0
    while left.any():
        uses = Counter(fill(left))
        repeat = max(1, min(_lasting(int(left[n]), k) for n, k in uses.items()))
        offset = 0
        for n in sorted(uses, reverse=True):
            slots.append(Slots(n, int(given[n]), sequence, uses[n], offset))
            given[n] += uses[n] * repeat
            left[n] -= uses[n] * repeat
            offset += uses[n] * n
        sequence += repeat
    return slots


def _lasting(left: int, uses: int) -> int:
    """How often a sequence with ``uses`` of ``left`` pieces can be made while two pieces more than it takes are there each time.

    The choice of a pair looks at two pieces beyond those taken; with so many left it is the same each time.
    """
    return (left - uses - 2) // uses + 1


# printable ASCII and the Latin letters with marks that are one code point below U+0100: composed already,
# each with one lower-case letter, so what the tokenizer's first two steps do to them is known
_PLAIN = re.compile(r"[!-~À-ÖØ-Þß-öø-ÿ]+")
_CLASSES = ((r"\p{L}", "a-zA-ZÀ-ÖØ-Þß-öø-ÿ"), (r"\p{N}", "0-9"))


def _steps(content: str) -> tuple[list[dict], list[dict], list[dict]]:
    said = json.loads(content)
    return (said.get("normalizer") or {}).get("normalizers", []), (said.get("pre_tokenizer") or {}).get("pretokenizers", []), said.get("added_tokens", [])


def cuts_at_white_space(content: str) -> bool:
    """Whether a tokenizer's file says that runs of white space become one blank, and that pieces never hold it."""
    changes, cuts, added = _steps(content)
    said = json.loads(content)
    blank = [c.get("type") for c in changes] == ["NFC", "Replace", "Lowercase"] and changes[1].get("pattern") == {"Regex": r"\s+"} and changes[1].get("content") == " "
    kinds = [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
    outside = kinds and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in cuts[0].get("pattern", {}).get("Regex", "")
    alone = all(not a.get("lstrip") and not a.get("rstrip") and not a.get("single_word") and not re.search(r"\s", a["content"]) for a in added)
    return bool(blank and outside and alone and not said.get("truncation") and not said.get("padding"))


@lru_cache(maxsize=1)
def _tokenizer(content: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit integers, of words between ASCII white space.

    The tokenizer must drop white space and cut there, so that a text's ids are those of its words
    one after the other; ``cuts_at_white_space`` checks its file for that. Words of plain letters
    and signs are cut by the file's own pattern and go to the library's model piece by piece, which
    remembers a piece whatever its case and the signs around it. All other words, and those that may
    hold an added token, go through the whole tokenizer.
    """

    def __init__(self, content: str):
        super().__init__()
        _, cuts, added = _steps(content)
        self.tokenizer = _tokenizer(content)
        self.model, self.bytes_of = self.tokenizer.model, self.tokenizer.pre_tokenizer[1]
        self.special = {a["content"][0] for a in added}
        self.cut = re.compile(reduce(lambda p, c: p.replace(*c), _CLASSES, cuts[0]["pattern"]["Regex"]))
        self.bytes_by_id = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else self.bytes_of.pre_tokenize_str(piece)[0][0]
        ids = b"".join([self.bytes_by_id[t.id] for t in self.model.tokenize(mapped)])
        if len(self.known) < WORDS_KEPT:
            self.known[piece] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if len(word) <= LONGEST_KEPT and _PLAIN.fullmatch(text) and self.special.isdisjoint(text):
            known = self.known
            ids = b"".join([known.get(p) or self._piece(p) for p in self.cut.findall(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST_KEPT and len(self) < WORDS_KEPT:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(maxsize=1)
def _words(content: str) -> WordIds:
    """What a worker remembers stays for its next task."""
    return WordIds(content)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END, doc_id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its ids and the end id, cut into ``size`` ids where there are more.

    ``part`` is the task that made the row and ``nth`` its number among the task's pieces of that
    length; both are settled only when the rows are written. A null text is empty: its one piece is
    the end id. Repeated rows and null ids give pieces like any other. No shuffle.
    """
    if not 0 < size < 1 << 15:
        raise ValueError(f"a sequence of {size} tokens; 1 to {(1 << 15) - 1} are possible")
    content = Path(tokenizer_file).read_text()
    if len(content) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_file} has {len(content)} characters; at most {MAX_TOKENIZER_BYTES} are sent to the executors")
    if not cuts_at_white_space(content):
        raise ValueError(f"{tokenizer_file} does not cut at white space")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    schema = pa.schema(list(zip(names, types)))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _words(shared.value), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        rows: list[tuple] = []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.of(value.as_py() or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    n = len(cut) // 4
                    row = (key, piece, at // 4, n, zlib.crc32(cut), part, seen[n])
                    rows.append((*row, np.frombuffer(cut, "<i4")) if with_ids else row)
                    seen[n] += 1
                    if len(rows) == ROWS_OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    ddl = PIECES + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with the ``sequence_id`` and the ``offset`` of their place; sequences are numbered from 0.

    ``cut`` is what ``pieces`` gives, written and read back, so that ``part`` and ``nth`` stay. A
    piece's rank among all pieces of its length is its number in its task and how many the tasks
    before have; a length that most pieces have is ranked task by task. An empty table gives no rows.
    """
    spark = cut.sparkSession
    told = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in told.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots = plan(counts, size)
    shared = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, len(Slots._fields)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = told.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")
    names = ranked.columns
    place = names.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = table[:, 0] << 48 | table[:, 1]  # by length, then by rank; ranks stay below 2**48
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            of = table[np.searchsorted(starts, length << 48 | rank, "right") - 1] if len(table) else table
            nth = rank - of[:, 1]
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            columns += [pa.array(of[:, 2] + nth // of[:, 3]), pa.array(of[:, 4] + nth % of[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != "rank"] + ["sequence_id", "offset"])

    kept = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END, doc_id: str = "doc_id",
              text: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents packed: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    cut = stored(pieces(docs, tokenizer_file, size, end, doc_id, text, with_ids), "pieces")
    return pack(cut, size)
