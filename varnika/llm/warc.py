"""WARC archives: writing, normalising and reading.

Archives are first written as one gzip stream per file, as some crawlers do. The normaliser inflates such a stream once,
rewrites every record as a gzip member of its own, and writes a sidecar index with the place of each member, so that a reader can
fetch any record alone. All files lie in the folder that the machines share. A file gets its final name once it is
complete, and only files listed by a finished task are read, so a lost executor leaves nothing half done.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, filesystem, keep, shared_path

ROLL = 64 << 20
#: Up to so many repeated payloads (28 bytes each) are broadcast to the pages; beyond it, the join shuffles.
BROADCAST_ROWS = 200_000
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}').urn}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the page of the response."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page}")
    block = HTTP + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page-Id: {'' if page is None else page}", f"X-Payload-Bytes: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {k.lower(): v for k, v in fields.items()}
    return headers, rest[: int(headers["content-length"])]


def records(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file of one or many members, inflated as a stream; at most one record and a chunk are in memory."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need = 0
    while chunk := stream.read(size):
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        at = 0
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = re.search(rb"\r\nContent-Length: *(\d+)", held[at : end + 2], re.I)
                need = end + 4 - at + int(length[1]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held:
        raise ValueError("the stream ends within a record")


class _Output:
    """A file under a name of this attempt, which close() moves to its final name."""

    def __init__(self, folder: str, suffix: str):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.path = f"{path}/{self.name}"
        self.file, self.size = self.fs.open_output_stream(f"{self.path}.open", compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.file.close()
        self.fs.move(f"{self.path}.open", self.path)
        return self.name


def write(pages: DataFrame, folder: str, level: int = 3, roll: int = ROLL) -> DataFrame:
    """Write (page, url, html, refers_to) as archives of one gzip stream each; one row (file, records) per archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, done, n = None, 0, 0
        for b in batches:
            for page, url, html, refers in zip(b["page"], b["url"], b["html"], b["refers_to"], strict=True):
                if out is None:
                    out, pack, done, n = _Output(folder, ".warc.gz"), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = record(None if pd.isna(page) else int(page), url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(refers) else int(refers))
                out.write(pack.compress(data))
                done, n = done + len(data), n + 1
                if done >= roll:
                    out.write(pack.flush())
                    yield pd.DataFrame({"file": [out.close()], "records": [n]})
                    out = None
        if out is not None:
            out.write(pack.flush())
            yield pd.DataFrame({"file": [out.close()], "records": [n]})

    with arrow_batches(pages.sparkSession, 256):
        return keep(pages.mapInPandas(run, "file string, records long"), "archives")


def normalise(archives: DataFrame, source: str, folder: str, level: int = 3) -> DataFrame:
    """Rewrite each archive with one gzip member per record and a sidecar index; one row (file, records) per archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                fs, path = filesystem(f"{source}/{file}")
                out, index = _Output(folder, ".warc.gz"), []
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in records(stream):
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(data) + pack.flush()
                        headers, _ = parse(data)
                        index.append({"id": headers["warc-record-id"], "type": headers["warc-type"], "uri": headers["warc-target-uri"], "digest": headers["warc-payload-digest"], "offset": out.size, "length": len(member)})
                        out.write(member)
                side, where = filesystem(f"{folder}/{out.name}.idx")
                with side.open_output_stream(where, compression=None) as lines:
                    for x in index:
                        lines.write(json.dumps(x).encode() + b"\n")
                yield pd.DataFrame({"file": [out.close()], "records": [len(index)]})

    return keep(archives.select("file").mapInPandas(run, "file string, records long"), "normalised")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Fetch every record of normalised archives through its index; payloads are checked against their digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                fs, path = filesystem(f"{folder}/{file}")
                with fs.open_input_stream(f"{path}.idx", compression=None) as lines:
                    index = [json.loads(x) for x in lines.read().splitlines()]
                rows = []
                with fs.open_input_file(path) as data:
                    for x in index:
                        headers, block = parse(zlib.decompress(data.read_at(x["length"], x["offset"]), 31))
                        kind, told = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(headers["x-payload-bytes"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if digest(payload) != told or len(payload) != size:
                                raise ValueError(f"{file}: the payload at {x['offset']} differs from its digest")
                        page, refers = headers["x-page-id"], headers.get("x-refers-to-page")
                        rows.append((int(page) if page else None, size, told, kind, int(refers) if refers else None))
                made = pd.DataFrame(rows, columns=["page", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
                yield made.astype({"page": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return archives.select("file").mapInPandas(run, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, level: int = 3) -> DataFrame:
    """Write all pages, normalise the archives and read them back: one row per page.

    Of pages with equal payloads of at least `least` bytes, that with the largest key is a response and the others are revisits to
    it; smaller payloads are responses. Null html is an empty payload, null url a urn; a null key is lower than all, and repeated rows
    of the largest key are all responses. Very long pages are one record each; other columns, whatever their names, are not read. An empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    best = rows.groupBy("sha").agg(F.max("page").alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    best = keep(best.select(F.col("sha").alias("_sha"), "_best"), "best")
    best = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    again = (F.octet_length("html") >= least) & F.col("_best").isNotNull() & ~F.col("page").eqNullSafe(F.col("_best"))
    rows = rows.join(best, F.col("sha") == F.col("_sha"), "left").select("page", "url", "html", F.when(again, F.col("_best")).alias("refers_to"))
    raw, folder = shared_path(spark, "warc-raw"), shared_path(spark, "warc")
    written = write(rows, raw, level)
    n = max(1, written.count())
    done = normalise(written.repartition(n), raw, folder, level)
    fs, path = filesystem(raw)
    if str(fs.get_file_info(path).type) == "FileType.Directory":
        fs.delete_dir(path)
    return read(done.repartition(n), folder).withColumnRenamed("page", key)
