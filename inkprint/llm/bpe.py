"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15  # characters; longer texts are split at safe boundaries
LONG_RUN = 1 << 10  # characters; the library's matcher overflows its stack on very long runs of blanks or signs
MAX_RANK_BYTES = 64 << 20  # a rank file is sent to every executor, so its size is checked

# Between an ASCII letter or digit and a following blank or line feed every match of the pattern
# ends: no alternative holds white space after other characters, and a run of white space that
# ends before the letter has its look-ahead answered by the letter.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
_RUN = re.compile(rf"\s{{{LONG_RUN}}}|[^ \n]{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def _pieces(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(text: str, ranks: bytes, pattern: str) -> list[int]:
    """The ids of a text; a long text chunk by chunk, cut at safe boundaries only."""
    encoding = _encoding(ranks, pattern)
    ids: list[int] = []
    start = 0
    while start < len(text):
        cut = _SAFE.search(text, start + CHUNK) if start + CHUNK < len(text) else None
        part = text[start : cut.start() if cut else len(text)]
        if _RUN.search(part):
            for match in _pieces(pattern).finditer(part):
                ids += encoding._encode_single_piece(match.group())
        else:
            ids += encoding.encode_ordinary(part)
        start += len(part)
    return ids


def decode(ids: list[int], ranks: bytes, pattern: str) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8."""
    return _encoding(ranks, pattern).decode_bytes(ids)


def tokenize(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
             with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    The ids are those of the whole text (null: empty, no ids), each match of ``pattern`` on its
    own, special tokens treated as ordinary text; ``decoded_sha256`` is of the bytes the ids decode
    to. Repeated rows and null ids give a row each; other columns are left out. No shuffle.
    """
    ranks = Path(rank_file).read_bytes()
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_file} has {len(ranks)} bytes; at most {MAX_RANK_BYTES} are sent to the executors")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for value in batch.column(1):
                ids = encode(value.as_py() or "", table, pattern)
                little = np.array(ids, dtype="<u4")
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(little.tobytes()).hexdigest())
                rows[2].append(hashlib.sha256(decode(ids, table, pattern)).hexdigest())
                if with_ids:
                    rows[3].append(little.astype("i4"))
            columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(rows[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
