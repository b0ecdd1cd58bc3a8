"""WARC archives of pages, one Zstandard frame per record behind a dictionary.

An archive file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a
Zstandard frame; each record follows as a frame of its own, so that a record can be read by its offset. The
dictionary is built from the file's own records. A file's name holds the attempt of the task that wrote it, and
the manifest lists the files of the attempts that counted: a task that runs again, perhaps with its rows in
another order, never touches them, and what a lost attempt wrote is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 48 << 10
#: The dictionary takes at most this share of the records.
DICTIONARY_SHARE = 8
#: The dictionary is built from pieces of at most so many bytes in all, spread evenly over the bytes of the file's records.
SAMPLE_BYTES = 1 << 20
PIECE_BYTES = 4 << 10
FILE_BYTES = 12 << 20
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id {id}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes | None, n: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; without ``payload`` it is a revisit of the page ``refers_to``."""
    revisit = payload is None
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {n}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {refers_to}')}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    else:
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else b""


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from pieces spread over all records; where they are too few or too unlike to train one, the pieces
    themselves. Records of under 64 bytes in all have none."""
    total = sum(map(len, records))
    if total < 64:
        return b""
    size = min(DICTIONARY_BYTES, max(64, total // DICTIONARY_SHARE))
    step = PIECE_BYTES * max(1, -(-total // SAMPLE_BYTES))
    pieces, skip = [], 0  # skip: bytes until the next piece begins
    for r in records:
        pieces += [r[at : at + PIECE_BYTES] for at in range(skip, len(r), step)]
        skip = (skip - len(r)) % step
    if len(pieces) >= 16:
        try:
            return zstandard.train_dictionary(size, pieces, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # pieces that have nothing in common
            pass
    part = max(1, size // len(pieces))
    return b"".join(p[:part] for p in pieces)[:size]


def archive(records: list[bytes], level: int = 3) -> bytes:
    raw = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=9).compress(raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed, *map(compressor.compress, records)])


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, read piece by piece."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(stream.read(size))
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = b""
    while True:
        one, out = decompressor.decompressobj(), []
        while not one.eof:
            rest = rest or stream.read(READ_BYTES)
            if not rest:
                if out:
                    raise ValueError("the archive ends inside a record")
                return
            out.append(one.decompress(rest))
            rest = one.unused_data
        yield b"".join(out)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        done, held, size = [], [], 0

        def close() -> None:
            name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.zst"
            data = archive(held)
            with files.open_output_stream(name, compression=None) as f:
                f.write(data)
            done.append((name, len(held), len(data)))

        for b in batches:
            for page_id, url, html, n, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(6))):
                held.append(record(page_id, url, None if refers_to is not None else (html or "").encode(), n, digest, refers_to))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, minimum: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` to archives in ``folder``; returns the manifest ``path, records, bytes``.

    Of records with equal payloads of at least ``minimum`` bytes, that with the largest page id is a response and
    the others revisit it; smaller ones are all responses. A null payload counts as empty, a null url as an empty
    one. Rows that repeat the largest id with an equal payload are all responses. Further columns are ignored.
    A null id is written without one and read back as null; it is never the largest. Ids are integers: others are written as text,
    and reading them back raises.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"))
    # Narrow keys find who revisits whom; the page itself moves once, by its id.
    keys = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").cast("long").alias("n"))
    groups = keys.where(F.col("n") >= minimum).groupBy("sha", "n").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = stored(
        keys.join(groups, ["sha", "n"]).where(F.col("page_id") != F.col("last")).select(F.col("page_id").alias("id"), F.col("sha").alias("key"), "last").distinct(),
        "revisits",
    )
    kept = rows.withColumn("sha", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long"))
    kept = kept.join(again, (F.col("page_id") == F.col("id")) & (F.col("sha") == F.col("key")), "left")
    body = F.when(F.col("last").isNull(), F.col("html"))
    out = kept.select("page_id", "url", body.alias("html"), "n", F.col("sha"), "last")
    out = out.withColumn("sha", _base32(F.col("sha")))
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    manifest = out.mapInArrow(_writer(folder), MANIFEST)
    path = f"{folder}-manifest"
    manifest.write.mode("overwrite").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def _base32(hex_sha1: F.Column) -> F.Column:
    """Upper-case base32 of a SHA-1 in hex: 40 hex digits are 8 groups of 20 bits, each 4 letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for g in range(8):
        value = F.conv(F.substring(hex_sha1, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(alphabet), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _reader(folder: str, cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        fields, payload = parse(data)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        response = fields["warc-type"] == "response"
                        if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: the payload of page {fields['x-page-id']} doesn't have its digest")
                        number = lambda v: int(v) if v else None
                        n = len(payload) if response else int(fields["x-payload-length"])
                        rows.append((number(fields["x-page-id"]), fields["warc-target-uri"], payload, n, digest, fields["warc-type"], number(fields.get("x-refers-to-page"))))
                        size += len(payload)
                        if size > READ_BYTES:
                            yield cast(rows)
                            rows, size = [], 0
                if rows:
                    yield cast(rows)

    return run


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` lists, each payload checked against its digest.

    ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``; a revisit has an empty
    payload, with length and digest of the full one. Without ``payloads`` that column is null.
    """
    names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def cast(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        if not payloads:
            cols[2] = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    paths = manifest.select("path")
    paths = paths.repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)), "path")
    return paths.mapInArrow(_reader(folder, cast), RECORDS.format(id="bigint")).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def roundtrip(pages: DataFrame, folder: str | None = None, minimum: int = 0) -> DataFrame:
    """Archive ``pages`` and read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    manifest = write_archives(pages, folder, minimum)
    back = read_archives(spark, manifest, folder, pages.schema["page_id"].dataType.simpleString(), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
