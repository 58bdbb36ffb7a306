"""A deterministic sharded WARC writer with revisit records, and its reader.

Records are sorted by page id and cut into shards of about equal bytes. Each task writes its
shards into files that roll at a compressed size, under temporary names of its own attempt; the
files of successful attempts are listed in a stored manifest, moved to their final names and only
then published by the final manifest. A lost executor's attempt leaves files nobody lists.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import lookup, stored
from inkprint.session import work_folder

SHARD_BYTES = 64 << 20  # payload bytes per shard, about
ROLL_BYTES = 32 << 20  # compressed bytes after which a new file begins
MIN_REVISIT = 0  # payloads with fewer bytes are never revisits
BINS = 1 << 12  # id ranges whose bytes are summed to place the shard borders
DATE = "2000-01-01T00:00:00Z"  # fixed, so that equal input gives equal files
_NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = (
    "shard int, seq int, temporary string, file string, n_records long, n_bytes long, sha256 string, first_id long, last_id long"
)
_RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, place long"
)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the path in it."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int = 0) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the full length, but no payload."""
    digest = digest_of(payload)
    name = lambda of, n: uuid.uuid5(_NAMES, f"{of}/{digest}/{n}").urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name(page_id, copy)}>", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to, 0)}>"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes the records of one shard into files of limited compressed size."""

    def __init__(self, system: fs.FileSystem, folder: str, shard: int, roll: int) -> None:
        self.system, self.folder, self.shard, self.roll = system, folder, shard, roll
        self.seq, self.out, self.done = -1, None, []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.out is None:
            self.seq += 1
            self.path = f"{self.folder}/part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.out, self.hash = self.system.open_output_stream(self.path, compression=None), hashlib.sha256()
            self.n = self.size = 0
            self.first = page_id
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member per record, no time stamp
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.hash.update(member)
        self.n, self.size, self.last = self.n + 1, self.size + len(member), page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = self.path.rsplit("/", 1)[1]
            self.done.append((self.shard, self.seq, self.path, name, self.n, self.size, self.hash.hexdigest(), self.first, self.last))
            self.out = None


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes every row as a record below ``folder`` and returns the published manifest.

    Null html is an empty payload, a null address gives no target, a null id no page id (such rows
    are dealt out by their payload). Of rows with equal payloads the one with the largest id is the
    response (nulls are smallest; of equal rows one of them), the others revisit it. An empty table
    gives an empty manifest. Equal rows give equal files.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("key", F.sha2(F.encode("html", "utf-8"), 256))
    sizes = stored(rows.select("page_id", "key", F.octet_length("html").cast("long").alias("n_bytes")), "warc-sizes")
    groups = stored(
        sizes.filter(F.col("n_bytes") >= min_revisit).groupBy("key")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1"), "warc-groups",
    )
    about = sizes.agg(F.count("*").alias("n"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    width = max(1, -(-((about["high"] or 0) - (about["low"] or 0) + 1) // BINS))
    spot = F.coalesce(F.floor((F.col("page_id") - F.lit(about["low"] or 0)) / F.lit(width)), F.lit(-1) - F.pmod(F.xxhash64("key"), F.lit(BINS)))
    by_bin = sizes.groupBy(spot.cast("long").alias("bin")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    bins, shard, held = [], 0, 0
    for found in sorted(by_bin.collect()):  # at most 2 * BINS rows
        if held >= shard_bytes:
            shard, held = shard + 1, 0
        bins.append((found["bin"], shard))
        held += found["n_bytes"] + 512 * found["n"]
    shards = F.broadcast(spark.createDataFrame(bins, "bin long, shard int"))
    copies = lookup(sizes.select("page_id", "key"), groups, "key", "copies", about["n"], "inner")
    notes = copies.groupBy("page_id", "key").agg(F.max("last").alias("last"))  # what precedes a page that has copies
    both = rows.select("page_id", "key", "url", "html", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("last")).unionByName(
        notes.select("page_id", "key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(0).alias("kind"), "last")
    )
    dealt = (
        both.withColumn("bin", spot.cast("long")).join(shards, "bin").repartitionById(shard + 1, "shard")
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "key", "kind", "url")
        .select("shard", "page_id", "key", "url", "html", "kind", "last")
    )

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        own = f"{base}/_temporary/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        roller: _Roller | None = None
        noted, seen = None, 0
        for batch in batches:
            for shard_no, page, key, address, text, kind, last in zip(*(c.to_pylist() for c in batch.columns)):
                if roller is None or roller.shard != shard_no:
                    if roller is not None:
                        roller.close()
                        yield _rows(roller.done, _MANIFEST)
                    roller = _Roller(system, own, shard_no, roll_bytes)
                if kind == 0:
                    noted, seen = (page, key, last), 0
                    continue
                has_copies = noted is not None and noted[:2] == (page, key)
                revisit = has_copies and (noted[2] != page or seen > 0)
                roller.add(page, record(page, address, text.encode(), noted[2] if revisit else None, revisit, seen if has_copies else 0))
                seen += 1
        if roller is not None:
            roller.close()
            yield _rows(roller.done, _MANIFEST)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(n).to_pylist() for n in ("temporary", "file", "n_bytes"))):
                final = f"{base}/{name}"
                if system.get_file_info(temporary).type != fs.FileType.NotFound:
                    system.move(temporary, final)
                elif system.get_file_info(final).size != size:  # else an earlier attempt has moved it
                    raise OSError(f"{name} is neither in its temporary nor in its final place")
            yield batch

    written = stored(dealt.mapInArrow(write_shards, _MANIFEST), "warc-written")
    written.mapInArrow(move, _MANIFEST).drop("temporary").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one record each; one record is in memory at a time."""
    rest, packer, parts = b"", zlib.decompressobj(31), []
    while data := rest or stream.read(chunk):
        rest = b""
        parts.append(packer.decompress(data))
        if packer.eof:
            yield b"".join(parts)
            rest, packer, parts = packer.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """What a record says, its digests checked against its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page-ID"), "payload_bytes": length, "payload_digest": digest, "payload": payload,
    }


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives the manifest of ``folder`` lists, one task per some files.

    A damaged record or digest raises. Payloads of revisits are empty. Column ``place`` is the
    record's number in its file.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest")
    names = [f.split()[0] for f in _RECORDS.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for place, data in enumerate(members(stream)):
                        row = parse(data) | {"file": name, "place": place}
                        rows.append([row[n] for n in names])
                        held += len(data) if with_payload else 200
                        if held > 1 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                yield _batch(rows, with_payload)

    n = max(1, min(10_000, manifest.count()))
    return manifest.select("file").repartition(n, "file").mapInArrow(run, _RECORDS + ", payload binary" * with_payload)


def _batch(rows: list[list], with_payload: bool) -> pa.RecordBatch:
    base = _rows([tuple(r[:8]) for r in rows], _RECORDS)
    return base.append_column("payload", pa.array([r[8] for r in rows], pa.binary())) if with_payload else base


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to a fresh folder below the shared one and reads the archives back."""
    folder = work_folder(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return read(pages.sparkSession, folder)
