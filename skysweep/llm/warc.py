"""WARC archives with Zstandard dictionaries: writer and reader.

Writer: records of a partition go to files of about FILE_BYTES before compression. A file begins with a skippable frame (magic
0x184D2A5D) that holds the dictionary; every record is a frame of its own, compressed with that dictionary. The dictionary is trained on a
bounded sample of the records to be archived. Files have names of their own for each attempt; only those in the table that the writer returns
count, so that a repeated or lost task leaves no record twice. Reader: takes the dictionary from the file, then the records one by one.

Of records with equal payloads of at least min_revisit bytes, that with the largest page_id is a response and the others
are revisits that refer to it and hold no payload; smaller ones are all responses. Rows with that id are all responses, and so are records of a
group without any id. A null payload is empty, a null url leaves the target out. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.functions.stored import new_path
from skysweep.llm.common import written

MAGIC = 0x184D2A5D
FILE_BYTES = 256 << 20
#: Bytes of the dictionary; records in its sample, and the size up to which a record enters it.
DICTIONARY, SAMPLE_RECORDS, SAMPLE_BYTES = 112_640, 1500, 65_536


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC 1.1 record whose block is an HTTP response; that of a revisit has the HTTP head only."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves, as raw content, where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def planned(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, payload, sha1, refers_to)."""
    rows = pages.selectExpr("page_id", "url", "coalesce(cast(html as binary), cast('' as binary)) as payload").withColumn("sha1", F.sha1("payload"))
    last = rows.where(f"octet_length(payload) >= {min_revisit}").groupBy("sha1").agg(F.max("page_id").alias("last"))
    rows = rows.join(last, "sha1", "left")
    return rows.select("page_id", "url", "payload", "sha1", F.expr("case when not (page_id <=> last) then last end").alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in folder; a table (path, records) of the files that count."""
    records = planned(pages, min_revisit)
    share = min(1.0, 2 * SAMPLE_RECORDS / max(1, pages.count()))
    picked = pages.where(f"octet_length(html) <= {SAMPLE_BYTES} and pmod(xxhash64(html, url), 1048576) < {int(share * 1048576) + 1}")
    picked = picked.orderBy(F.xxhash64("html", "url"), "html", "url").limit(SAMPLE_RECORDS)  # the same ones in every run
    samples = [record(0, r.url, r.html.encode(), "A" * 32, None) for r in picked.select("url", "html").collect()]
    trained = dictionary(samples)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = system.open_output_stream(f"{base}/{name}")
                    out.write(struct.pack("<II", MAGIC, len(trained)) + trained)
                whole = record(page_id, url, payload, _base32(sha1), refers_to)
                out.write(packer.compress(whole))
                count, size = count + 1, size + len(whole)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.record_batch({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})

    return written(records.mapInArrow(write, "path string, records long"))


def records_of(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    trained = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    text = io.BufferedReader(unpacker.stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := text.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("no record here")
        head = {}
        while (line := text.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            head[name] = value
        block = text.read(int(head["Content-Length"]))
        if text.read(4) != b"\r\n\r\n":
            raise ValueError("record cut short")
        yield head, block


def read_archive(files: DataFrame, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """One row per record of files (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = _open(path)
                rows, size = [], 0
                with system.open_input_stream(at) as stream:
                    for head, block in records_of(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        own = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                        to = head.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                        row = (int(own) if own else None, head.get("WARC-Target-URI"), length, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], int(to) if to else None)
                        rows.append((*row, payload if head["WARC-Type"] == "response" else None) if with_payload else row)
                        size += len(block) if with_payload else 200
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = [pa.int64() if id_type in ("long", "bigint") else pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
    kinds += [kinds[0], *[pa.binary()] * with_payload]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    form = f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}" + ", payload binary" * with_payload
    return files.select("path").repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(read, form)


def archive_folder(pages: DataFrame) -> str:
    return new_path(pages.sparkSession, "warc")


ORACLE = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s from pages),
m as (select s, max(page_id) l from p group by s),
d as (select page_id, h, l, [('0x' || substr(s, 1 + 10 * i, 10))::bigint for i in range(4)] q from p join m using (s))
select page_id, octet_length(encode(h))::bigint payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[(i // 8 + 1)::int] >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), 'string_agg', '') payload_digest,
  case when page_id is distinct from l and l is not null then 'revisit' else 'response' end record_type,
  case when page_id is distinct from l then l end refers_to from d
"""
