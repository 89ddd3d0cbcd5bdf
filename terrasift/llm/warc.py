"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing: each task writes archives of its own to the shared folder and reports them in a manifest. The manifest is kept
as a table, so only archives of tasks that succeeded are known; a task run again writes new ones. Reading: archives are
dealt to tasks by the manifest, read in pieces, and every record is checked (version, lengths, separators, digests).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.store import keep, sized
from terrasift.shared import shared_dir

#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of a Zstandard frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Bytes of payload in an archive, of the dictionary, of all samples for it; least payload that may become a revisit.
ARCHIVE, DICT, SAMPLES, LEAST = 64 << 20, 32 << 10, 2 << 20, 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records bigint, n_bytes bigint"


class WarcError(ValueError):
    """An archive or a record that doesn't follow the format."""


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    if not (uri.startswith("<urn:x-page:") and uri.endswith(">")):
        raise WarcError(f"record id {uri!r}")
    value = uri[12:-1]
    return None if value == "null" else int(value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or with refers_to a revisit that has the payload's length and digest but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}"] if url else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: {b32(payload)}",
        f"WARC-Block-Digest: {b32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for revisits), payload_bytes, payload_digest; checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("length of the block")
    block, kind = rest[:-4], fields["warc-type"]
    digest = lambda name: base64.b32decode(fields[name].removeprefix("sha1:"))
    if "warc-block-digest" in fields and hashlib.sha1(block).digest() != digest("warc-block-digest"):
        raise WarcError("digest of the block")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not length or not length[0].isdigit():
        raise WarcError("HTTP header")
    if kind == "response":
        if int(length[0]) != len(payload) or hashlib.sha1(payload).digest() != digest("warc-payload-digest"):
            raise WarcError("length or digest of the payload")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise WarcError(f"record of type {kind}")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(length[0]),
        "payload_digest": digest("warc-payload-digest").hex(),
    }


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little to train on, the samples themselves."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICT, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICT:]


class ArchiveWriter:
    def __init__(self, stream, dictionary: bytes):
        self.stream, self.size, self.records = stream, 0, 0
        self._put(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
        args = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.coder = zstandard.ZstdCompressor(level=3, write_checksum=True, **args)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.coder.compress(record))
        self.records += 1


def read_records(stream, piece: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        raise WarcError("no dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise WarcError("dictionary cut short")
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    coder = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    data = stream.read(piece)
    while data:
        frame, out = coder.decompressobj(), []
        while not frame.eof:
            if not data:
                raise WarcError("frame cut short")
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame: {e}") from e
            data = frame.unused_data if frame.eof else stream.read(piece)
        yield b"".join(out)
        data = data or stream.read(piece)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str | None = None, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Write a record per page; returns the kept manifest (path, n_records, n_bytes).

    Of pages with equal payloads of at least ``LEAST`` bytes the largest page_id is a response, all with smaller ones are
    revisits of it; so are none with a null page_id. Repeated rows are records of their own. A null html is an empty
    payload, a null url is left out; a page of any length is one record. Only the named columns are read, whatever else there
    is. An empty table gives an empty manifest. folder: a URI that all executors share, by default one in spark.checkpoint.dir.
    """
    folder = folder or shared_dir(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long"))
    equal = rows.filter(F.col("n") >= LEAST).groupBy("sha", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).filter("c > 1").drop("c")
    rows = rows.join(sized(keep(equal)), ["sha", "n"], "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))

    def write(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        made, stream, writer, waiting, size = [], None, None, [], 0

        def opened():
            dictionary = make_dictionary([w[:20_000] for w in waiting])
            name = f"{root}/pages-{uuid.uuid4().hex}.warc.zst"
            out = fs.open_output_stream(name)
            return name, out, ArchiveWriter(out, dictionary)

        def flush():
            nonlocal stream, writer, name, size
            if stream is None and waiting:
                name, stream, writer = opened()
            for w in waiting:
                writer.add(w)
            waiting.clear()

        def close():
            nonlocal stream, size
            flush()
            if stream is not None:
                stream.close()
                made.append((f"{folder}/{name.rpartition('/')[2]}", writer.records, writer.size))
            stream, size = None, 0

        name, held = None, 0
        for batch in batches:
            for page_id, link, body, refers in zip(*(batch.column(c).to_pylist() for c in (0, 1)), batch.column(2).cast("binary").to_pylist(), batch.column(3).to_pylist(), strict=True):
                record = make_record(page_id, link, body, refers)
                waiting.append(record)
                size += len(record)
                held += len(record)
                if stream is not None or held >= SAMPLES:
                    flush()
                    held = 0
                if size >= ARCHIVE:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["path", "n_records", "n_bytes"])

    return keep(rows.mapInArrow(write, MANIFEST))


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the manifest's archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest and,
    if asked for, payload (null for revisits). A damaged archive, or one with other than its count of records, is an error."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payload else [])]
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}

    def read(batches):
        made, size = [], 0
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _filesystem(path)
                n = 0
                with fs.open_input_stream(name) as stream:
                    for record in read_records(stream):
                        got = parse_record(record)
                        made.append(got)
                        n += 1
                        size += len(record) if payload else 300
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([m[f] for m in made], t) for f, t in fields], names=[f for f, _ in fields])
                            made, size = [], 0
                if n != count:
                    raise WarcError(f"{path} has {n} records of {count}")
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[f] for m in made], t) for f, t in fields], names=[f for f, _ in fields])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "path").mapInArrow(read, ", ".join(f"{f} {kinds[t]}" for f, t in fields))
