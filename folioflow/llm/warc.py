"""WARC archives compressed record by record with an embedded dictionary.

An archive starts with one skippable Zstandard frame that holds a dictionary
built from the archive's own records; every record follows as a frame of its
own, so a reader can seek to any record and still profit from what records share.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import shared_dir, written
from folioflow.session import table

#: Magic number of the skippable frame that carries the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Records of an archive that its dictionary is built from: every n-th, so that about this many bytes are seen.
TRAINING_BYTES = 4 << 20
#: Records from which a dictionary can be learnt, and the bytes of each that a raw one takes where they are fewer.
LEARNT_FROM, RAW_BYTES = 8, 1024
#: Bytes that a reader hands to the library at a time.
PIECE = 16 << 10
#: Equal payloads shorter than this stay whole.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def record_bytes(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers of its capture and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (html or "").encode()
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """The inverse of record_bytes(), as a row of RECORD; the digest of a response is taken from its payload again."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.split(b"Content-Length: ")[1])
    of = lambda key: None if (x := fields[key].removeprefix("<urn:page:").removesuffix(">")) == "null" else int(x)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"a damaged record: {fields['WARC-Record-ID']}")
    return of("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, kind, of("WARC-Refers-To") if kind == "revisit" else None, payload.decode() if kind == "response" else None


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of what records share: learnt from them, or where they are too few to learn from, the beginnings of them as raw content."""
    every = max(1, sum(map(len, records)) // TRAINING_BYTES)
    picked = records[::every]
    try:
        if len(picked) >= LEARNT_FROM:
            return zstandard.train_dictionary(DICTIONARY_BYTES, picked).as_bytes()
    except zstandard.ZstdError:  # too little, or too much alike, to learn from
        pass
    return b"".join(r[:RAW_BYTES] for r in picked)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary's skippable frame, then one frame for each record."""
    plain = dictionary(records)
    comp = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(plain) if plain else None)
    return struct.pack("<II", DICTIONARY_MAGIC, len(plain)) + plain + b"".join([comp.compress(r) for r in records])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time. Input goes to the library in pieces, so what lies behind a record is not copied for it."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    plain, at, view = data[8 : 8 + n], 8 + n, memoryview(data)
    decomp = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain) if plain else None)
    while at < len(data):
        one, out = decomp.decompressobj(), []
        while not one.eof:
            piece = view[at : at + PIECE]
            if not piece:
                raise ValueError("an archive cut short")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def put(uri: str, name: str, data: bytes) -> str:
    """Writes a file into the shared folder under a temporary name and renames it, so a retried task leaves no half file."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        folder = unquote(parsed.path)
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{folder}/{name}")
    else:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, f"{folder}/{name}")
    return f"{uri}/{name}"


def write_archives(pages: DataFrame, folder: str, archive_mb: int = 16) -> DataFrame:
    """Writes rows (page_id, url, html, digest, size, refers_to) to archives in `folder` and returns their manifest (path, records, bytes).

    An archive holds the records of one task up to `archive_mb` MB of raw
    records. The manifest, not a listing of the folder, says which files count.
    """

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            data = archive(pending)
            path = put(folder, f"{uuid.uuid4().hex}.warc.zst", data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(pending)], "bytes": [len(data)]})

        pending: list[bytes] = []
        held = 0
        for batch in it:
            for row in batch.to_pylist():
                pending.append(record_bytes(row["page_id"], row["url"], row["html"], row["digest"], row["size"], row["refers_to"]))
                held += len(pending[-1])
                if held >= archive_mb << 20:
                    yield flush()
                    pending, held = [], 0
        if pending:
            yield flush()

    return pages.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(write, "path string, records long, bytes long")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records (RECORD) of the archives that a manifest names; Spark's binary reader opens the files."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in it:
            for data in batch.column(0):
                rows: list[tuple] = []
                for raw in read_archive(data.as_py()):
                    rows.append(parse_record(raw))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    folder = manifest.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).first()
    if folder is None:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder[0])
    name = F.regexp_extract("path", "([^/]*)$", 1)
    named = files.withColumn("name", name).join(manifest.select(name.alias("name")), "name", "left_semi")
    return named.select("content").mapInArrow(read, RECORD)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds digest (hex SHA-1), size (bytes) and refers_to: of equal payloads of LEAST_REVISIT bytes or more the row with the largest page_id is kept whole.

    The digests alone are aggregated and joined, so one payload that many pages
    share moves no text and its rows split freely; only revisits (page_id,
    refers_to) meet the texts again, on page_id. Rows that repeat the largest
    page_id are all kept whole. Rows without a page_id are kept whole.
    """
    text = F.coalesce("html", F.lit(""))
    told = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    long = told.where((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest", "size")
    last = long.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = long.join(last, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return told.join(revisits, ["page_id", "digest"], "left")


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Archives every page row (page_id, url, html) and returns what the archives say when read back.

    A null html is an empty payload; null urls leave out the target header; line
    ends inside a url are percent-encoded; page
    rows that are repeated give a record each; further columns are not archived.
    Without pages there are no archives and no rows.
    """
    manifest = written(write_archives(with_revisits(pages.select("page_id", "url", "html")), folder), "manifest")
    return read_archives(pages.sparkSession, manifest)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` written to archives in the shared folder and read back; see round_trip() for null and repeated rows."""
    back = round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
