"""Removes every byte of a text that an earlier text has too, in stretches of 50 bytes or more.

Blockwise suffix sorting: the suffixes of one bucket at a time are sorted by their first 50 bytes,
and ties are resolved eight bytes at a time, the rank so far before the next eight. The
cover sample that makes this possible at scale is chosen by content: of the 31 20-byte strings in a
50-byte string the one with the least hash is its sample. Equal strings have equal samples at equal
distances, which is what a difference cover guarantees by position, with a sixteenth of all places
instead of a quarter and more.

1. Equal texts are grouped; only the first text of a group goes on.
2. Neighbouring suffixes with one sample form a run. Runs are found once and stored with the text.
   Samples travel as packed arrays, once per batch of texts; those that one text has alone are out.
3. Equal runs are grouped; in all but the first text of a group every suffix of the run is a repeat.
4. Where different runs share a sample, they are compared by slots: suffixes whose distance to the
   sample differs by less than 8 have 43 bytes in common. Only suffixes of slots that different runs
   share are sorted, in the slot's bucket and by their bytes. A bucket with very many different runs
   is split by a hash of the 50 bytes.

Samples and runs are compared by 64-bit hashes at least, suffixes by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm import packed as pk
from inkprint.llm.common import HOT_PARTS, lookup, stored
from inkprint.session import work_folder

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
TEXT_BYTES = 32 << 20  # bytes of text per part of the table of texts
BATCH_BYTES = 8 << 20  # bytes of text whose samples travel together
BUCKET_SAMPLES = 1 << 19
BUCKET_BYTES = 2 << 20  # bytes of runs that are sorted together
SPLIT_RUNS = 4096  # runs of one sample that stay together
STEP = 1 << 16  # places that are hashed at a time
SLOT = 8  # neighbouring suffixes that are compared together before any is sorted
SLOTS = -(-WINDOW // SLOT)
_COVER = (0, 8, 16, 24, 32, 40, LENGTH - 8)  # eight bytes each: all of a suffix
EMPTY = hashlib.sha256(b"").hexdigest()

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_KEYS = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
_PLACE = _U((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def _words(codes: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers; no copy."""
    return np.ndarray(max(0, len(codes) - 7), "<u8", codes, strides=(1,))


def _hashed(words: np.ndarray, seed, *reads: tuple[np.ndarray, tuple[int, ...]]) -> np.ndarray:
    """Hashes of the words at some distances from the places of ``reads``, a few thousand at a time."""
    out = np.empty(len(reads[0][0]), np.uint64)
    out[:] = seed
    out += _U(1)
    for at in range(0, len(out), 1 << 13):
        h = out[at : at + (1 << 13)]
        h *= _U(_P)
        for places, distances in reads:
            here = places[at : at + (1 << 13)]
            for k in distances:  # every bit reaches all others before the next word comes
                h ^= h >> _U(29)
                h += words[here + k]
                for key in _KEYS[:2]:
                    h *= key
                    h ^= h >> _U(32)
        h[:] = _mix(h)
    return out


def window_hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the 50 bytes from each place on."""
    return _hashed(_words(codes), 0, (at, _COVER))


def spots_of(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of texts of 50 bytes or more that stand one behind the other, and how many each has.

    A run is all neighbouring suffixes with one sample, the first of the least 20-byte strings of
    their 50 bytes; so it has 31 suffixes at most. Per run: its suffixes, and the sample's distance.
    """
    words, total = _words(codes), len(codes) - LENGTH + 1
    place = np.empty(total, np.uint8)
    for at in range(0, total, STEP):
        n = min(STEP, total - at)
        w = np.array(words[at : at + n + WINDOW + 11])
        low = w[:-12] * _KEYS[0]
        low += w[8:-4] * _KEYS[1]
        low += w[12:] * _KEYS[2]
        low ^= low >> _U(32)
        low *= _KEYS[0]
        low &= ~_PLACE
        low |= np.arange(len(low), dtype=np.uint64)  # of equal strings the first
        width = 1
        while 2 * width <= WINDOW:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: -(WINDOW - width)], low[WINDOW - width :])
        place[at : at + n] = (low & _PLACE) - np.arange(n, dtype=np.uint64)
    new = np.ones(total, bool)
    new[1:] = place[1:] + np.uint8(1) != place[:-1]
    new[(start[1:-1, None] - np.arange(1, LENGTH)).ravel()] = False  # these would reach into the next text
    new[start[:-1]] = True
    begin = np.flatnonzero(new)
    of = np.searchsorted(start, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], total), start[1:][of] - LENGTH + 1)
    return np.stack([(end - begin).astype(np.uint8), place[begin]], 1), np.bincount(of, minlength=len(start) - 1)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column and where each begins; no copy if it is one array."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, starts, data = column.buffers()
    start = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    codes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return codes[start[0] : start[-1]], start - start[0]


def of_text(classes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Classes and the texts of a batch that they belong to as one number."""
    return _mix(classes + of.astype(np.uint64) * _U(_P))


class Runs:
    """The runs of some texts from their stored spots; hashes are of the runs that ``pick`` chooses."""

    def __init__(self, texts, spots) -> None:
        self.codes, self.start = _flat(texts)
        self.words = _words(self.codes)
        both, where = _flat(spots)
        both, self.cut = both.reshape(-1, 2), where // 2
        size = both[:, 0].astype(np.int64)
        self.of = np.repeat(np.arange(len(self.start) - 1), np.diff(self.cut))
        before = np.cumsum(size) - size
        self.begin = self.start[self.of] + before - before[self.cut[self.of]]
        self.end = self.begin + size
        self.place = self.begin + both[:, 1]

    def samples(self) -> np.ndarray:
        return _hashed(self.words, 0, (self.place, (0, 8, 12)))

    def classes(self, pick=slice(None)) -> np.ndarray:
        """Hashes of all bytes of the runs: 50 to 80, so the first 50 and the last 32 hold each."""
        begin, end = self.begin[pick], self.end[pick]
        seed = (end - begin << 8) + self.place[pick] - begin
        return _hashed(self.words, seed, (begin, _COVER), (end + LENGTH - 1, (-32, -24, -16, -8)))

    def own_classes(self) -> np.ndarray:
        return of_text(self.classes(), self.of)

    def slots(self, pick, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that begin 8 * slot to 8 * slot + 7 bytes before the sample: a hash of what all of them hold, their first and the one after their last."""
        near, far = SLOT * slot, min(SLOT * slot + SLOT, WINDOW) - 1
        place = self.place[pick]
        first, last = np.maximum(self.begin[pick], place - far), np.minimum(self.end[pick], place - near + 1)
        some = np.flatnonzero(first < last)
        held, at = LENGTH - far + near, place[some] - near
        key = np.zeros(len(place), np.uint64)
        key[some] = _hashed(self.words, slot, (at, (0, 8, 16, 24, 32, held - 8))) >> _U(32) | _U(1)
        return key, first, np.maximum(first, last)


def _with_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            spots, count = spots_of(*_flat(batch.column(2)))
            where = np.append(0, 2 * np.cumsum(count)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(where), pa.py_buffer(spots.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*batch.schema.names, "spots"])


def _batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.Table]:
    """Rows in groups of about BATCH_BYTES of text."""
    pieces, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.diff(_flat(batch.column(column))[1]))
        at = done = 0
        while at < batch.num_rows:
            upto = min(int(np.searchsorted(size, done + BATCH_BYTES - held)) + 1, batch.num_rows)
            pieces.append(batch.slice(at, upto - at))
            held, at, done = held + int(size[upto - 1]) - done, upto, int(size[upto - 1])
            if held >= BATCH_BYTES:
                yield pa.Table.from_batches(pieces)
                pieces, held = [], 0
    if pieces:
        yield pa.Table.from_batches(pieces)


REMOVED, OPEN, PLACES = 1, 2, 3


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sample_sender(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            runs = Runs(rows.column("text"), rows.column("spots"))
            keys = np.split(pk.key_of(runs.samples(), buckets), runs.cut[1:-1])
            yield from pk.ask_shared([(row, np.unique(key)) for row, key in zip(_numbers(rows, "row").tolist(), keys)], buckets)

    return send


def _by_part(row: np.ndarray, values: np.ndarray, kind: int, parts: int) -> list[tuple]:
    """Answers for the texts of a part in one row: a bucket gives out as many as there are parts, not as many as texts."""
    number = row.view(np.uint64)
    return pk.per_row((number % _U(parts)).astype(np.int64), np.column_stack([number, values]), kind)


def _per_text(table: pa.Table) -> pa.Table:
    """One row per text of a part and kind of answer."""
    said = []
    for kind, width in ((REMOVED, 2), (OPEN, 3)):
        data = pk.blobs(table.filter(pc.equal(table.column("kind"), kind)).column("data").to_pylist()).reshape(-1, width)
        said += pk.per_row(np.ascontiguousarray(data[:, 0]).view(np.int64), data[:, 1:], kind)
    return pa.Table.from_batches([pk.table(pk.SAID, said)])


def _among(known: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where in ``known``, which is in order, each of ``own`` is; -1 if it is not."""
    if not len(known):
        return np.full(len(own), -1)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return np.where(known[at] == own, at, -1)


def _run_sender(buckets: int, text_parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            runs = Runs(rows.column("text"), rows.column("spots"))
            sample = runs.samples()
            keys = np.split(pk.key_of(sample, buckets), runs.cut[1:-1])
            shared = [np.frombuffer(v, np.uint64) for v in rows.column("shared").to_pylist()]  # each in order
            pick = np.flatnonzero(np.concatenate([_among(known, key) >= 0 for known, key in zip(shared, keys)]))
            if not len(pick):
                continue
            run, of = runs.classes(pick), runs.of[pick]
            order, row = _numbers(rows, "ord")[of], _numbers(rows, "row")[of]
            by, group = pk.groups(row, order, run)
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (row[by][1:] != row[by][:-1])])  # a text's equal runs count once
            by = by[new]
            pick, run, order, row = pick[by], run[by], order[by], row[by]
            change = np.concatenate([[True], run[1:] != run[:-1]])
            later = order > order[np.flatnonzero(change)][np.cumsum(change) - 1]
            yield pk.table(pk.SENT, pk.pass_on(_by_part(row[later], run[later], REMOVED, text_parts), buckets))
            ask = ~later
            pick = pick[ask]
            slots = [runs.slots(pick, k)[0] for k in range(SLOTS)]
            yield pk.table(pk.SENT, pk.send(
                pk.bucket_of(sample[pick], buckets).astype(np.int64),
                np.stack([
                    sample[pick], run[ask], order[ask].view(np.uint64), row[ask].view(np.uint64),
                    slots[0] | slots[1] << _U(32), slots[2] | slots[3] << _U(32),
                ], 1),
            ))

    return send


def _run_judge(text_parts: int):
    return lambda table: _judged(table, text_parts)


def _judged(table: pa.Table, text_parts: int) -> pa.Table:
    """Runs that an earlier text has too are repeats; slots that different runs share are open.

    Two equal suffixes of different runs have equal slots, so a run without such slots needs no sorting.
    """
    sent, known = pk.asked_and_known(table, 6)
    if not len(sent):
        return pa.Table.from_batches(known, pk.SAID)
    sample, run, order, row = sent[:, 0], sent[:, 1], sent[:, 2].view(np.int64), sent[:, 3].view(np.int64)
    by, group = pk.groups(order, run, sample)
    sample, run, order, row, slots = sample[by], run[by], order[by], row[by], sent[by, 4:]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    later = order > order[first][group]
    said = _by_part(row[later], run[later], REMOVED, text_parts)
    key = np.stack([slots[first, k // 2] >> _U(32 * (k % 2)) & _U(0xFFFFFFFF) for k in range(SLOTS)], 1)
    of, slot = np.nonzero(key)
    _, at, count = np.unique(slot_hash(sample[first][of], slot, key[of, slot]), return_inverse=True, return_counts=True)
    runs = np.zeros(key.shape, np.int64)  # how many different runs share the slot
    runs[of, slot] = count[at]
    asker, slot = np.nonzero((runs[group] > 1) & ~later[:, None])
    parts = (runs[group[asker], slot] - 1) // SPLIT_RUNS + 1
    said += _by_part(row[asker], np.stack([run[asker], (parts << 8 | slot).astype(np.uint64)], 1), OPEN, text_parts)
    return pa.Table.from_batches([*known, pk.table(pk.SAID, said)])


def slot_hash(sample: np.ndarray, slot: np.ndarray, key: np.ndarray) -> np.ndarray:
    return _mix(sample * _U(_P) + (key << _U(2) | slot.astype(np.uint64)))


def _suffix_sender(sorting: int):
    """Sends the bytes of open slots to the bucket of sample and slot: 5 numbers per slot, then the bytes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            runs = Runs(rows.column("text"), rows.column("spots"))
            sample = runs.samples()
            classes, first = np.unique(runs.own_classes(), return_index=True)  # equal runs of a text go once
            said, of = _told(rows.column("opened"))
            said, of = said.reshape(-1, 2), of[::2]
            at = _among(classes, of_text(said[:, 0], of))
            pick, tail = first[at[at >= 0]], said[at >= 0, 1].astype(np.int64)
            slot, parts = tail & 255, tail >> 8
            key, begin, end = np.zeros(len(pick), np.uint64), np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64)
            for k in range(SLOTS):
                key[slot == k], begin[slot == k], end[slot == k] = runs.slots(pick[slot == k], k)
            hot = np.flatnonzero(parts > 1)
            again, part = [np.flatnonzero(parts == 1)], [np.zeros(int((parts == 1).sum()), np.int64)]
            for k in hot.tolist():
                own_parts = np.unique(window_hashes(runs.codes, np.arange(begin[k], end[k])) % _U(parts[k])).astype(np.int64)
                again.append(np.full(len(own_parts), k))
                part.append(own_parts)
            again, part = np.concatenate(again), np.concatenate(part)
            pick, slot, key, begin, end, parts = (c[again] for c in (pick, slot, key, begin, end, parts))
            home = slot_hash(sample[pick], slot, key)
            bucket = (_mix(home ^ part.astype(np.uint64) * _U(0x2545F4914F6CDD1D)) % _U(sorting)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, begin, end, of = bucket[by], begin[by], end[by], runs.of[pick[by]]
            size = end - begin + LENGTH - 1
            head = np.stack([
                _numbers(rows, "row")[of], _numbers(rows, "ord")[of], begin - runs.start[of], size, (parts << 32 | part)[by],
            ], 1)
            where = np.append(0, np.cumsum(size))
            body = runs.codes[np.repeat(begin - where[:-1], size) + np.arange(where[-1])]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, int)
            yield pk.table(pk.SENT, [
                (int(bucket[a]), None, int(b - a), head[a:b].tobytes() + body[where[a] : where[b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])
            ])

    return send


def sort_ranks(codes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The ranks of the suffixes at ``at`` (all) by their first 50 bytes, or as far as the array goes.

    Eight bytes more at a time, as one number, sort those suffixes that still tie; the rank so far
    goes before the number.
    """
    at = np.arange(len(codes)) if at is None else at
    words = np.ndarray(len(codes) + LENGTH - 7, ">u8", np.concatenate([codes, np.zeros(LENGTH, np.uint8)]), strides=(1,))
    rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in _COVER:
        if not len(tied):
            break
        word = words[at[tied] + k].astype(np.uint64)
        order = np.lexsort((word, rank[tied])) if k else np.argsort(word, kind="stable")
        tied, word = tied[order], word[order]
        before, place = rank[tied], np.arange(len(tied))
        old = np.concatenate([[True], before[1:] != before[:-1]])
        new = old.copy()
        new[1:] |= word[1:] != word[:-1]
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[tied] = before + first - np.maximum.accumulate(np.where(old, place, 0))
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    return rank


def _suffix_judge(table: pa.Table) -> pa.Table:
    heads, bodies = [], []
    for n, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
        heads.append(np.frombuffer(data[: 40 * n], np.uint64).reshape(-1, 5))
        bodies.append(data[40 * n :])
    head, codes = np.concatenate(heads), np.frombuffer(b"".join(bodies), np.uint8)
    size = head[:, 3].astype(np.int64)
    start = np.cumsum(size) - size
    windows = size - LENGTH + 1
    of = np.repeat(np.arange(len(head)), windows)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = start[of] + inside
    parts, part = (head[:, 4] >> _U(32))[of], (head[:, 4] & _U(0xFFFFFFFF))[of]
    if (parts > 1).any():
        keep = window_hashes(codes, place) % parts == part
        of, inside, place = of[keep], inside[keep], place[keep]
    order = head[:, 1].view(np.int64)[of]
    by, group = pk.groups(order, sort_ranks(codes, place))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    later = by[order[by] > order[by][first][group]]
    row, at = head[:, 0].view(np.int64)[of[later]], head[:, 2][of[later]] + inside[later].astype(np.uint64)
    return pa.Table.from_batches([pk.table(pk.SAID, pk.per_row(row, at, PLACES))])


def _told(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that lists of packed numbers hold, and of which row each is."""
    lists = column.to_pylist()
    return pk.blobs([v for values in lists for v in values]), np.repeat(np.arange(len(lists)), [sum(map(len, values)) // 8 for values in lists])


def removed_mask(runs: Runs, classes: np.ndarray, of_class: np.ndarray, places: np.ndarray, of_place: np.ndarray) -> np.ndarray:
    """The removed bytes of all texts: of runs whose class goes whole, and of suffixes that go in all the text's runs of a class."""
    own, edge = runs.own_classes(), np.zeros(len(runs.codes) + 1, np.int32)
    hit = _among(np.unique(of_text(classes, of_class)), own) >= 0
    np.add.at(edge, runs.begin[hit], 1)
    np.add.at(edge, runs.end[hit] + LENGTH - 1, -1)
    if len(places):
        at = runs.start[of_place] + places.astype(np.int64)
        run = np.searchsorted(runs.begin, at, "right") - 1
        known, which = np.unique(own[run], return_inverse=True)
        inside = np.zeros((len(known), WINDOW), bool)
        inside[which, at - runs.begin[run]] = True
        found = _among(known, own)
        hit = np.flatnonzero(found >= 0)
        run, far = np.nonzero(inside[found[hit]])
        at = runs.begin[hit[run]] + far
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LENGTH, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _batches(batches):
        runs = Runs(rows.column("text"), rows.column("spots"))
        mask = removed_mask(runs, *_told(rows.column("classes")), *_told(rows.column("places")))
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        begins[runs.start[:-1]] = mask[runs.start[:-1]]
        removed, spans = (np.add.reduceat(m, runs.start[:-1], dtype=np.int64) for m in (mask, begins))
        kept, where = runs.codes[~mask].tobytes(), np.append(0, np.cumsum(np.diff(runs.start) - removed)).tolist()
        digests = [hashlib.sha256(memoryview(kept)[a:b]).hexdigest() for a, b in zip(where[:-1], where[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_numbers(rows, "row")), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())], ["row", "n_removed", "n_spans", "kept_sha256"]
        )


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are their UTF-8 bytes, null is empty; matches never cross documents. A null id is smaller
    than any other; rows with one id, and repeated rows, remove nothing from each other. Texts under
    50 bytes keep all. Other columns are left out.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text")).withColumns({
        "key": F.sha2(F.encode("text", "utf-8"), 256), "ord": F.coalesce("doc_id", F.lit(-(1 << 63))),
    })
    narrow = stored(rows.select("doc_id", "ord", "key", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    classes = stored(narrow.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")), "classes")
    about = classes.agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n_bytes") * F.col("copies")).alias("with_copies")).first()
    n_bytes, total = about["n_bytes"] or 0, narrow.count()
    parts, buckets = max(1, -(-n_bytes // TEXT_BYTES)), max(1, -(-n_bytes // (16 * BUCKET_SAMPLES)))
    name = "inkprint_" + work_folder(spark, "t").rsplit("-", 1)[1]
    # texts are moved once: copies of texts that hold a thousandth of all bytes stay behind, so none unbalances the parts
    hot = classes.filter((F.col("copies") > 1) & (F.col("copies") * F.col("n_bytes") * HOT_PARTS >= (about["with_copies"] or 0))).select("key", F.col("first").alias("hot"))
    firsts = (
        classes.filter(F.col("n_bytes") >= LENGTH).select(F.xxhash64("key").alias("row"), F.struct("key", F.col("first").alias("ord")).alias("one"))
        .repartition(parts, "row").groupBy("row").agg(F.collect_list("one").alias("firsts"))
    )
    once = (
        rows.filter(F.octet_length("text") >= LENGTH).join(F.broadcast(hot), "key", "left").filter("hot IS NULL OR hot = ord")
        .select(F.xxhash64("key").alias("row"), "key", "ord", F.col("text").cast("binary").alias("text")).repartition(parts, "row")
        .join(firsts, "row").filter(F.array_contains("firsts", F.struct("key", "ord")))
        .select("row", "ord", "text").mapInArrow(_with_spots, "row long, ord long, text binary, spots binary")
    )
    # a table in buckets: later joins on the row do not move the texts again
    once.write.bucketBy(parts, "row").sortBy("row").option("path", work_folder(spark, "bodies")).option("compression", "zstd").saveAsTable(name)
    bodies = spark.table(name)

    told = bodies.select("row", "text", "spots").mapInArrow(_sample_sender(buckets), pk.SENT_DDL).groupBy("bucket").applyInArrow(pk.tell_shared(buckets), pk.SAID_DDL)
    shared = stored(told.groupBy("row").applyInArrow(pk.per_owner, pk.SAID_DDL).select("row", F.col("data").alias("shared")), "shared")

    runs = bodies.join(shared, "row").select("row", "ord", "text", "spots", "shared").mapInArrow(_run_sender(buckets, parts), pk.SENT_DDL)
    by_part = runs.groupBy("bucket").applyInArrow(_run_judge(parts), pk.SAID_DDL)
    judged = stored(by_part.groupBy("row").applyInArrow(_per_text, pk.SAID_DDL), "judged")

    opened = stored(judged.filter(F.col("kind") == OPEN).groupBy("row").agg(F.collect_list("data").alias("opened")), "opened")
    open_runs = judged.filter(F.col("kind") == OPEN).agg(F.sum(F.octet_length("data"))).first()[0] or 0
    sorting = max(1, -(-(open_runs // 16) * 2 * LENGTH // BUCKET_BYTES))
    suffixes = bodies.join(opened, "row").select("row", "ord", "text", "spots", "opened").mapInArrow(_suffix_sender(sorting), pk.SENT_DDL)
    places = suffixes.groupBy("bucket").applyInArrow(_suffix_judge, pk.SAID_DDL)

    gone = judged.filter(F.col("kind") == REMOVED).unionByName(places)
    per_text = gone.groupBy("row").agg(
        F.collect_list(F.when(F.col("kind") == REMOVED, F.col("data"))).alias("classes"), F.collect_list(F.when(F.col("kind") == PLACES, F.col("data"))).alias("places")
    )
    cut = stored(
        bodies.join(stored(per_text, "gone"), "row").select("row", "text", "spots", "classes", "places")
        .mapInArrow(_cut, "row long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["row"]), "cut",
    )
    spark.sql(f"DROP TABLE {name}")

    firsts = lookup(narrow, classes.filter("copies > 1").select("key", "first", "copies"), "key", "copies", total)
    copy = F.coalesce(F.col("ord") > F.col("first"), F.lit(False))
    marked = firsts.select("doc_id", "key", "n_bytes", copy.alias("copy"), F.when(~copy, F.xxhash64("key")).alias("row"))
    whole = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    alone = marked.filter("row IS NULL").select("doc_id", "n_bytes", "key", whole.alias("whole"), *(F.lit(None).cast(t).alias(c) for c, t in cut.dtypes if c != "row"))
    rest = marked.filter("row IS NOT NULL").join(cut, "row", "left").select("doc_id", "n_bytes", "key", F.lit(False).alias("whole"), "n_removed", "n_spans", "kept_sha256")
    zero = F.lit(0).cast("long")
    return rest.unionByName(alone).select(
        "doc_id", "n_bytes", F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(F.col("whole"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "key")).alias("kept_sha256"),
    )
