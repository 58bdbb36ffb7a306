"""Questions and answers about keys that travel as packed arrays, a row per batch and bucket.

Which keys do several owners have? Every batch of owners asks once per key, whatever the number of
its owners that have it: all but one know the answer already. So a key that a third of all owners
have makes a bucket longer by one entry per batch, not by one per owner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_LOW = _U(0x7FFFFFFF)
SHARED = 0


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets)) >> _U(32)


def key_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """A key's number: bucket and 31 bits of the hash; a collision lets a key through, no more."""
    return (bucket_of(h, buckets) << _U(32)) | (h & _LOW)


def table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def blobs(values: list) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64)


def per_row(rows: np.ndarray, values: np.ndarray, kind: int) -> list[tuple]:
    """(row, kind, packed values) of each row."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    return [(int(rows[c]), kind, part.tobytes()) for c, part in zip(cuts, np.split(values, cuts[1:]))] if len(rows) else []


SAID_DDL = "row long, kind int, data binary"
SAID = pa.schema([("row", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SENT_DDL = "bucket int, row long, kind int, data binary"


def send(bucket: np.ndarray, columns: np.ndarray) -> list[tuple]:
    """Rows of ``columns`` (n x k, uint64) packed per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], columns[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    return [(int(bucket[c]), None, None, part.tobytes()) for c, part in zip(cuts, np.split(columns, cuts[1:]))] if len(bucket) else []


def pass_on(said: list[tuple], buckets: int) -> list[tuple]:
    """Answers that are known already; they go the way of the questions, so that nothing is written twice."""
    return [(row % buckets, row, kind, data) for row, kind, data in said]


def asked_and_known(sent: pa.Table, width: int) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    known = sent.filter(pc.is_valid(sent.column("kind"))).select(["row", "kind", "data"])
    asked = sent.filter(pc.is_null(sent.column("kind"))).column("data")
    return blobs(asked.to_pylist()).reshape(-1, width), known.cast(SAID).to_batches()


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys, last one first, and the number of each sorted entry's group by all but the first key."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys[1:]:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def _by_part(owner: np.ndarray, key: np.ndarray, parts: int) -> list[tuple]:
    """(part, SHARED, pairs of owner and key): the shared keys of an owner meet in its part."""
    return per_row((owner.view(np.uint64) % _U(parts)).astype(np.int64), np.stack([owner.view(np.uint64), key], 1), SHARED)


def ask_shared(owned: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """What a batch of (owner, distinct keys) asks about its keys, and what it knows already.

    A question takes twelve bytes: 31 bits of the key, whether the batch has it twice, and the owner.
    """
    owned = [(owner, keys) for owner, keys in dict(owned).items() if len(keys)]
    if not owned:
        return
    key = np.concatenate([keys for _, keys in owned])
    owner = np.repeat(np.array([o for o, _ in owned], np.int64), [len(keys) for _, keys in owned])
    order, group = groups(owner, key)
    key, owner = key[order], owner[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    many = (np.bincount(group) > 1).astype(np.uint32) << np.uint32(31)
    yield table(SENT, [(part, part, kind, data) for part, kind, data in _by_part(owner[~first], key[~first], buckets)])
    mark, bucket, owner = (key[first] & _LOW).astype(np.uint32) | many, (key[first] >> _U(32)).astype(np.int64), owner[first]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # keys are in order, so buckets are
    yield table(SENT, [
        (int(bucket[at]), None, None, m.tobytes() + o.tobytes()) for at, m, o in zip(cuts, np.split(mark, cuts[1:]), np.split(owner, cuts[1:]))
    ])


def tell_shared(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Answers for one bucket: the keys that several owners have, by the owners' parts."""

    def tell(sent: pa.Table) -> pa.Table:
        bucket = _U(sent.column("bucket")[0].as_py())
        known = sent.filter(pc.is_valid(sent.column("kind"))).select(["row", "kind", "data"])
        asked = [v for v in sent.filter(pc.is_null(sent.column("kind"))).column("data").to_pylist()]
        mark = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(v, np.uint32, len(v) // 12) for v in asked)])
        owner = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(v, np.int64, offset=len(v) // 3) for v in asked)])
        low, many = mark.astype(np.uint64) & _LOW, mark >> np.uint32(31)
        order, group = groups(owner, low)
        low, many, owner = low[order], many[order], owner[order]
        again = np.zeros(len(order), bool)  # one owner may ask in several batches
        again[1:] = (group[1:] == group[:-1]) & (owner[1:] == owner[:-1])
        shared = np.zeros(len(order), bool)
        if len(order):
            shared = ((np.bincount(group, ~again) > 1) | (np.bincount(group, many) > 0))[group] & ~again
        told = table(SAID, _by_part(owner[shared], bucket << _U(32) | low[shared], buckets))
        return pa.Table.from_batches([*known.cast(SAID).to_batches(), told])

    return tell


def pairs(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owners and keys of packed pairs."""
    both = blobs(data).reshape(-1, 2)
    return both[:, 0].view(np.int64), both[:, 1]


def per_owner(part: pa.Table) -> pa.Table:
    """One row per owner of a part: its shared keys, each once."""
    owner, key = pairs(part.column("data").to_pylist())
    order, group = groups(key, owner)
    owner, key = owner[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return pa.Table.from_batches([table(SAID, per_row(owner[new], key[new], SHARED))])
