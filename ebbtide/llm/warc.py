"""WARC archives with dictionary-compressed records.

A Zstandard dictionary is trained on a bounded sample of the records to be archived. Every archive begins with a
skippable frame that holds the dictionary, so it can be read with nothing else at hand; each record follows as a frame
of its own. Payloads of at least ``MIN_REVISIT`` bytes are stored once: of the records with equal payloads the one with
the largest id is the response, and the others are revisits that refer to it.

Archives go to the cluster's shared folder. A task writes under a name of its own attempt, and only archives listed in
the written manifest are read, so a repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import in_pieces, table
from ebbtide.llm.queries import register
from ebbtide.session import shared_dir, written

MIN_REVISIT = 1000
#: Bound of the dictionary and of its training sample: one record per hash bucket, with so many characters of its
#: payload from a place that a hash names.
DICTIONARY_BYTES, SAMPLE_BUCKETS, SAMPLE_CHARS = 65_536, 512, 8_192
ARCHIVE_BYTES = 64 << 20
#: Fixed value: magic number of the leading skippable frame.
SKIPPABLE = 0x184D2A5D
LEVEL = 3
_READ = 1 << 18
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; the block is an HTTP response, of a revisit only its header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parsed(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP header, payload) of a record."""
    head, rest = record.split(b"\r\n\r\n", 1)
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return headers, http, payload


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes; where too little was sampled to train one, the sample itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: one without a scheme lies in Spark's default file system, wherever it is opened."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _open(uri: str):
    """File system and path of a URI."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class _Archive:
    def __init__(self, folder: str, name: str, dictionary: bytes):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        self.path, self.size, self.records = f"{folder}/{name}", 0, 0
        self.out = system.open_output_stream(f"{root}/{name}")
        self.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)


def revisits(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Pages with digest, size and the page to refer to (null: it is a response).

    Payloads are equal when their SHA-256 is. The largest id of a payload is an aggregate before the shuffle, and the
    join spreads a payload that very many pages share (adaptive execution splits its side).
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= MIN_REVISIT, F.sha2("payload", 256)))
    largest = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("largest"))
    joined = rows.join(largest, "key", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("largest") != F.col("page_id"), F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write every page as a record to archives in ``folder``; returns the manifest (archive, records, bytes).

    A null payload counts as empty, a null url gives a record without target. Rows that repeat an id are all written.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(payload_col).alias("html"), F.col(url_col).cast("string").alias("url"))
    folder = _qualified(pages.sparkSession, folder)
    sample = pages.where("html is not null").groupBy(F.pmod(F.xxhash64("page_id"), F.lit(SAMPLE_BUCKETS)).alias("bucket"))
    # a slice of the payload from a place that the page's hash names
    at = F.lit(1) + F.pmod(F.xxhash64("page_id", F.lit("at")), F.greatest(F.lit(1), F.length("html") - SAMPLE_CHARS + 1))
    part = F.substring("html", at.cast("int"), F.lit(SAMPLE_CHARS))
    least = F.min(F.struct(F.xxhash64("page_id", F.lit("order")).alias("o"), F.col("page_id").cast("long").alias("p"), "url", part.alias("h")))
    rows = sample.agg(least.alias("least")).select("bucket", "least.p", "least.url", "least.h").collect()
    slices = [(p, url, h.encode()) for _, p, url, h in sorted(rows, key=lambda r: r[0])]
    # records as they are archived, headers and all
    dictionary = train_dictionary([_record(p, url, h, hashlib.sha1(h).hexdigest(), None) for p, url, h in slices])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _dictionary(dictionary)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept).compress
        archive, made = None, []

        def close():
            if archive is not None:
                archive.out.close()
                made.append((archive.path, archive.records, archive.size))

        for part in parts:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                if archive is None or archive.size > ARCHIVE_BYTES:
                    close()
                    archive = _Archive(folder, f"pages-{uuid.uuid4().hex}.warc.zst", dictionary)
                archive.write(compress(_record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to)))
                archive.records += 1
        close()
        yield from in_pieces(made, "sll", ["archive", "records", "bytes"])

    manifest = revisits(pages, "page_id", "html").mapInArrow(run, "archive string, records long, bytes long")
    return written(manifest, "manifest")


def records_of(uri: str) -> Iterator[bytes]:
    """The records of an archive, one at a time, with the dictionary that its first frame holds."""
    system, path = _open(uri)
    with system.open_input_stream(path) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri}: no dictionary in front")
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(file.read(size)))
        frame, parts, data = decompressor.decompressobj(), [], file.read(_READ)
        while data:
            parts.append(frame.decompress(data))
            if frame.eof:
                yield b"".join(parts)
                data, frame, parts = frame.unused_data, decompressor.decompressobj(), []
                data = data or file.read(_READ)
            else:
                data = file.read(_READ)
        if parts:
            raise ValueError(f"{uri}: cut off")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in ``manifest``; the digest is made anew from a response's payload.

    A response whose payload doesn't match its digest raises an error; a revisit's size and digest are those it states.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(uri):
            for record in records_of(uri):
                headers, http, payload = _parsed(record)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                refers_to = headers.get("WARC-Refers-To")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if refers_to is None and (hashlib.sha1(payload).hexdigest() != digest or size != len(payload)):
                    raise ValueError(f"{uri}: payload of {headers['WARC-Record-ID']} doesn't match its digest")
                page_id = headers["WARC-Record-ID"][10:-1]
                yield (
                    None if page_id == "None" else int(page_id), headers.get("WARC-Target-URI"), size, digest,
                    headers["WARC-Type"], refers_to and int(refers_to[10:-1]), payload if refers_to is None else None,
                )

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for part in parts:
            for uri in part.column(0).to_pylist():
                yield from in_pieces(rows(uri), "lslssly", names, 500)

    # a task per archive: by the manifest's few bytes alone, very many archives would count as one task's work
    return manifest.select("archive").repartition(max(1, manifest.count())).mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


@register("op5_warc_dictionary")
def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to dictionary-compressed archives and read back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
