"""WARC archives with a shared Zstandard dictionary.

Writing: a dictionary is trained on a bounded sample of the records and broadcast
(``DICT_BYTES`` at most). Every archive begins with a skippable frame that holds
the dictionary; each record follows as a frame of its own, so one record can be
read without those before it. Of pages with equal payloads one is a response
record and the others are revisit records that refer to it. An archive is closed
by the record with which it reaches ``ARCHIVE_BYTES``.

Spark's text sink writes the archives through the cluster's file system, one row
a file; its line separator, which ends the file, is an empty skippable frame,
which every Zstandard reader passes over.

Reading: the archives are loaded as binary files, the frames are found by their
block headers and decompressed with the dictionary of their own archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm._scratch import materialize, scratch_path

# Fixed values of the formats.
DICT_FRAME = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # 0x184D2A50 and a length of 0, little-endian
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bounds of the dictionary, of its training sample, and of the compressed records of an archive before its last one.
DICT_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, ARCHIVE_BYTES = 65536, 400, 4_000_000, 16 << 20

READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The bytes of one uncompressed WARC record."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of READ_SCHEMA from one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    whole = {"page_id": "Page-Id", "refers_to": "Refers-To-Page-Id"}
    return {k: int(fields[v]) if v in fields else None for k, v in whole.items()} | {
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI", ""), "payload": None if revisit else payload,
    }


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Magic number and bytes of each frame; data frames whole, skippable ones without their head."""
    pos = 0
    while pos < len(data):
        magic = struct.unpack_from("<I", data, pos)[0]
        if magic != ZSTD_FRAME:
            size = struct.unpack_from("<I", data, pos + 4)[0]
            yield magic, data[pos + 8 : pos + 8 + size]
            pos += 8 + size
            continue
        start, flags = pos, data[pos + 4]
        single = flags >> 5 & 1
        pos += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            head = int.from_bytes(data[pos : pos + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            pos += 3 + (1 if kind == 1 else size)
        pos += 4 * (flags >> 2 & 1)
        yield magic, data[start:pos]


def train(samples: list[bytes], most: int = DICT_BYTES) -> bytes:
    """A dictionary for such records; the samples themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(most, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-most:]


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` as archives under ``path``.

    Null html is an empty payload. Of equal payloads of at least
    ``min_revisit_bytes``, those with the largest id are response records (the
    same page given twice is written twice) and the others revisit it; null ids
    are the smallest. An empty table gives a folder without records.
    """
    import zstandard

    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    known = materialize(keyed.select("id", "key", F.octet_length("html").alias("size")), "warc-keys")
    again = known.where(F.col("size") >= min_revisit_bytes).groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # written first, so that its size is known when the join is planned
    again = materialize(again.where("n > 1 and first is not null").select("key", "first"), "warc-repeated")

    # a hash of the id lets about four times the sample through; pages that repeat an id and a size count once
    share = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    near = known.where("id is not null").where(share * F.lit(known.count()) <= 4 * SAMPLE_ROWS).select("id", "size").distinct()
    picked, total = [], 0
    for r in near.orderBy(F.xxhash64("id"), "id", "size").limit(SAMPLE_ROWS).collect():
        if total + r["size"] <= SAMPLE_BYTES:
            picked.append((r["id"], r["size"]))
            total += r["size"]
    samples = []
    if picked:
        wanted = F.broadcast(spark.createDataFrame(picked, "w_id long, w_size long"))  # SAMPLE_ROWS rows
        found = rows.join(wanted, (F.col("id") == F.col("w_id")) & (F.octet_length("html") == F.col("w_size")))
        found = found.groupBy("w_id", "w_size").agg(F.min(F.struct("html", "url")).alias("r")).orderBy(F.xxhash64("w_id"), "w_size")
        samples = [record(x["w_id"], x["r"]["url"], x["r"]["html"].encode(), None, False, date) for x in found.collect()]
    shared = spark.sparkContext.broadcast(train(samples) if samples else b"")

    ready = keyed.join(again, "key", "left").select("id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=6)
        head = struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary
        archive = lambda own: pa.RecordBatch.from_arrays([pa.array([b"".join([head, *own])], pa.binary())], ["archive"])
        own, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for r in batch.slice(k, 64).to_pylist():
                    revisit = r["first"] is not None and r["id"] != r["first"]
                    own.append(coder.compress(record(r["id"], r["url"], r["html"].encode(), r["first"] if revisit else None, revisit, date)))
                    size += len(own[-1])
                    if size >= ARCHIVE_BYTES:
                        yield archive(own)
                        own, size = [], 0
        if own:
            yield archive(own)

    (
        ready.mapInArrow(run, "archive binary")
        .select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_FRAME)
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, with READ_SCHEMA; payload is null for revisit records."""
    import zstandard

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                decoder, found = zstandard.ZstdDecompressor(), []
                for magic, body in frames(memoryview(content.as_buffer())):
                    if magic == DICT_FRAME:
                        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(body))) if len(body) else zstandard.ZstdDecompressor()
                    elif magic == ZSTD_FRAME:
                        found.append(parse(decoder.decompress(body)))
                    if len(found) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds, strict=True)], names)
                        found = []
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(run, READ_SCHEMA)


def archive_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
