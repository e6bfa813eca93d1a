"""WARC archives, index first: every record's file, offset, length, URL and digest are written with it.

Tasks write gzip members (one record each) to files in a shared folder and return the index rows, which
Spark commits as Parquet; a retried task writes another file, and only the committed attempt's rows name it.
Reading sorts the selected index rows by file and offset and coalesces neighbours into ranges of bounded
size, so many records cost one read. Any file system that pyarrow opens by its URI will do.

Keys of any type that casts to text and back are written as percent-encoded text.

Of records with equal payloads of at least `min_bytes`, that with the smallest key is the response and the
others are revisits that refer to it and hold no payload; smaller payloads are always responses.

Defined cases: a null payload is empty; rows that repeat both the smallest key and the payload are responses;
a null key is written as such and refers or responds like any other, after all others; a null url leaves the
field out; line ends in a url are percent-encoded; an empty table writes an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.plans.shared import bound_batches, fresh_path, materialise, skew_lookup

INDEX = "key string, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "key string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _open_folder(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return _file_system(uri)


def _urn(key: str | None) -> str:
    return "<urn:nokey>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def _key(urn: str | None) -> str | None:
    return None if urn in (None, "<urn:nokey>") else unquote(urn[len("<urn:page:") : -1])


def record_bytes(key: str | None, url: str | None, payload: bytes, digest: str, first: str | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record around an HTTP response, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(raw: bytes) -> dict:
    """The fields of RECORD from one gzip member; a response's payload is hashed again and must fit its digest."""
    head, rest = zlib.decompress(raw, 31).split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "key": _key(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": _key(fields.get("WARC-Refers-To")),
        "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None,
    }


def _writer(folder: str, min_bytes: int, date: str, file_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open_folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for key, url, payload, sha1, first in zip(batch["key"], batch["url"], batch["payload"], batch["sha1"], batch["first"], strict=True):
                    key, first = (None if pd.isna(x) else x for x in (key, first))
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    payload = bytes(payload)
                    revisit = len(payload) >= min_bytes and key != first and first is not None
                    raw = record_bytes(key, url, payload, digest, first, revisit, date)
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)  # the members are compressed already
                    out.write(raw)
                    rows.append((key, url, digest, "revisit" if revisit else "response", name, at, len(raw)))
                    at += len(raw)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> tuple[str, DataFrame]:
    """Write every row as a record; (folder, index). The index lies in the folder's `index`, one Parquet row per record."""
    bound_batches(pages.sparkSession)
    folder = fresh_path(pages.sparkSession, "warc")
    system, root = _open_folder(folder)
    system.create_dir(root, recursive=True)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    sha1 = F.sha1(body)
    first = pages.select(F.col(f"`{key}`").alias("key"), sha1.alias("sha1")).groupBy("sha1").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows"))
    first = materialise(first, "warc-first")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), body.alias("payload"), sha1.alias("sha1"))
    met = skew_lookup(rows, first, "sha1", "rows", "key")
    met = met.select(F.col("key").cast("string"), "url", "payload", "sha1", F.col("first").cast("string"))
    index = met.mapInPandas(_writer(folder, min_bytes, date, file_bytes), INDEX)
    index.write.parquet(f"{folder}/index")
    return folder, pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(folder: str, gap: int, range_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open_folder(folder)
        file, name = None, ""

        def fetch(ranges: list) -> pd.DataFrame:
            start = ranges[0][0]
            file.seek(start)
            data = file.read(max(o + n for o, n in ranges) - start)
            return pd.DataFrame([parse_record(data[o - start : o - start + n]) for o, n in ranges])

        held: list = []
        for batch in batches:
            for path, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                end = held[-1][0] + held[-1][1] if held else 0
                if held and (path != name or offset > end + gap or offset + length - held[0][0] > range_bytes):
                    yield fetch(held)
                    held = []
                if path != name:
                    file = system.open_input_file(f"{root}/{path}")
                    name = path
                held.append((int(offset), int(length)))
        if held:
            yield fetch(held)

    return run


def read_records(folder: str, selected: DataFrame, gap: int = 1 << 16, range_bytes: int = 1 << 22, stripe: int = 1 << 22, task_bytes: int = 1 << 27, key_type: str = "long") -> DataFrame:
    """RECORD rows of the selected index rows, keys as `key_type`. Files are dealt out in stripes, so one large file is read
    by many tasks, and their number follows the archive's bytes, not the index's: `task_bytes` each at most, about."""
    spark = selected.sparkSession
    size = selected.agg(F.sum("length")).first()[0] or 0
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-size // stripe), max(usual, -(-size // task_bytes))))
    dealt = selected.select("file", "offset", "length").withColumn("stripe", F.floor(F.col("offset") / stripe))
    dealt = dealt.repartition(tasks, "file", "stripe").sortWithinPartitions("file", "offset")
    found = dealt.mapInPandas(_reader(folder, gap, range_bytes), RECORD)
    return found.withColumns({"key": F.col("key").cast(key_type), "refers_to": F.col("refers_to").cast(key_type)})
