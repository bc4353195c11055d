"""WARC archives: a gzip member per record, written and read in sequence.

An archive that this module writes is a table of segments (archive, seq, data): its
segments in order of seq are a .warc.gz file byte for byte, and each is whole members.
That way archives live wherever Spark can write; ``export`` makes files of them.
``entries`` reads any .warc.gz files of that form, whoever wrote them."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import plain, staged

SEGMENT = 2_000_000  # bytes after which a segment ends
DATE = "2024-01-01T00:00:00Z"
LEAST = 100  # bytes from which equal payloads are stored once
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(ValueError):
    """The archive breaks off, or a record isn't what it says."""


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """A response, or with ``refers`` a revisit of that page's response."""
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head[2:2] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def page(self, name: str = "warc-record-id") -> int | None:
        """The page that an id of our own stands for."""
        found = re.fullmatch(r"<urn:page:(-?\d+)>", self.headers.get(name, ""))
        return int(found[1]) if found else None

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def is_http(self) -> bool:
        return self.headers.get("content-type", "").replace(" ", "").lower().startswith("application/http")

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        pairs = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}, body

    def payload(self) -> bytes:
        """What was transferred: of an HTTP message its body (as it is stored), else the block."""
        return self.http()[1] if self.is_http() else self.block


def _unchunked(body: bytes) -> bytes | None:
    """A body without its transfer coding in chunks; None if it has none."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end] if end >= 0 else b"")
        if size is None:
            return None
        n = int(size[0], 16)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) < n:
            return None
        if n == 0:
            return b"".join(out)
        at = end + 2 + n + 2


def _agrees(said: str, data: bytes) -> bool:
    """Whether a labelled digest is that of the data, in base 32 or hexadecimal; those
    of unknown algorithms can't be told and agree."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha384", "sha512", "md5"):
        return True
    raw = hashlib.new(name, data).digest()
    return value.strip().rstrip("=").upper() in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What each gzip member unpacks to; of the archive one chunk is held."""
    z, parts, some = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            some = True
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                raise Damaged(str(e)) from e
            chunk = b""
            if z.eof:
                chunk = z.unused_data
                yield b"".join(parts)
                z, parts, some = zlib.decompressobj(31), [], False
    if some:
        raise Damaged("the archive ends within a record")


def read(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records in order, of any type: one member each, framed by Content-Length, with
    their block digest and (of responses and resources) payload digest verified."""
    for data in _members(chunks):
        head, mark, rest = data.partition(b"\r\n\r\n")
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "surrogateescape")).split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            raise Damaged("not a WARC record")
        r = Record({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])})
        try:
            size = int(r.headers["content-length"])
        except (KeyError, ValueError) as e:
            raise Damaged("no length") from e
        if rest[size:] != b"\r\n\r\n":
            raise Damaged("the length is wrong")
        r.block = rest[:size]
        if not _agrees(r.headers.get("warc-block-digest", ""), r.block):
            raise Damaged("the block isn't what its digest says")
        said = r.headers.get("warc-payload-digest", "")
        # A segment's payload is only part of what its digest is of.
        if r.kind in ("response", "resource") and said and "warc-segment-number" not in r.headers:
            body = r.payload()
            if not _agrees(said, body) and ((plain := _unchunked(body)) is None or not _agrees(said, plain)):
                raise Damaged("the payload isn't what its digest says")
        yield r


def _slices(data: bytes) -> Iterator[bytes]:
    return (data[k : k + 65536] for k in range(0, len(data), 65536))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size, archive, seq = [], 0, None, 0
    for pdf in batches:
        for part, page, url, html, digest, refers in zip(pdf["part"], pdf["page_id"], pdf["url"], pdf["html"], pdf["digest"], pdf["first"], strict=True):
            archive = part if archive is None else archive
            body = (html or "").encode("utf-8", "surrogatepass")
            data = member(record(None if pd.isna(page) else int(page), url, body, digest, None if pd.isna(refers) else int(refers)))
            held.append(data)
            size += len(data)
            if size >= SEGMENT:
                yield pd.DataFrame({"archive": [archive], "seq": [seq], "data": [b"".join(held)]})
                held, size, seq = [], 0, seq + 1
    if held:
        yield pd.DataFrame({"archive": [archive], "seq": [seq], "data": [b"".join(held)]})


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    for pdf in batches:
        for data in pdf["data"]:
            rows = []
            for r in read(_slices(data)):
                if r.kind not in ("response", "revisit") or not r.is_http():
                    continue
                whole = r.kind == "response"
                fields, body = r.http()
                try:
                    size = len(body) if whole else int(fields["content-length"])
                except (KeyError, ValueError) as e:
                    raise Damaged("a revisit of no length") from e
                said = r.headers.get("warc-payload-digest", "")
                digest = hashlib.sha256(body).hexdigest() if whole else said.partition(":")[2]
                rows.append((r.page(), size, digest, r.kind, r.page("warc-refers-to"), r.headers.get("warc-target-uri", "")))
            out = pd.DataFrame(rows, columns=names)
            yield plain(out).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives of ``pages(page_id, url, html, ...)``: a table of segments
    (archive long, seq int, data binary) in the shared folder.

    Of pages whose payload (html in UTF-8, null: empty) is equal and has ``least``
    bytes or more, the one with the smallest page_id is a response and the others
    are revisits of it; rows that repeat its id are responses too.  Where all of
    them have a null id, all are responses, and a null id otherwise revisits the
    smallest.  A null url is stored as an empty one.  Other columns are ignored.
    No pages, no segments."""
    ship(pages.sparkSession)
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    slim = p.select("page_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("size")).where(F.col("size") >= least)
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    again = slim.join(first, "digest").where("page_id is null or page_id <> first").select(F.col("page_id").alias("pid"), F.col("digest").alias("dig"), "first").distinct()
    p = p.withColumn("digest", F.sha2(raw, 256))
    told = p.join(again, p["page_id"].eqNullSafe(again["pid"]) & (p["digest"] == again["dig"]), "left")
    told = told.select(F.spark_partition_id().cast("long").alias("part"), "page_id", "url", "html", "digest", "first")
    return staged(told.mapInPandas(_pack, "archive long, seq int, data binary"), "warc")


def records(archives: DataFrame) -> DataFrame:
    """Reads archives of pages back, each record once: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url.  The first two of a revisit are those
    of the payload that it stands for; they are compared with the response that it
    refers to, which must be in the archives.  Records of other types are no pages and
    left out, ids that aren't of pages are null.  A damaged archive, or a revisit of
    nothing or of another payload, is an error.  No segments, no records."""
    ship(archives.sparkSession)
    rows = archives.select("data").mapInPandas(_unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    rows = staged(rows, "warc-records")
    # As many rows as there are payloads that are stored once for several pages.
    again = rows.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.min("page_id").alias("page"))
    there = rows.where("record_type = 'response'").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).distinct()
    lost = again.join(there, (again["refers_to"] == there["p"]) & (again["payload_digest"] == there["d"]) & (again["payload_bytes"] == there["b"]), "left_anti").first()
    if lost is not None:
        raise Damaged(f"page {lost.page} revisits page {lost.refers_to}, which has no such payload")
    return rows


ENTRY = "file string, place long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, declared_digest string, payload binary"


def _entries(payloads: bool):
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, size = [], 0
                for n, r in enumerate(read(_slices(data))):
                    body, h = r.payload(), r.headers
                    own = None if r.kind == "revisit" else (len(body), hashlib.sha256(body).hexdigest())
                    text = lambda k, h=h: h[k].encode("utf-8", "surrogateescape").decode("utf-8", "replace") if k in h else None
                    rows.append((path, n, r.kind, text("warc-record-id"), text("warc-target-uri"), text("warc-date"), text("warc-refers-to"), *(own or (None, None)), text("warc-payload-digest"), body if payloads and own else None))
                    size += len(body) if payloads else 0
                    if size > SEGMENT or len(rows) >= 10_000:
                        yield plain(pd.DataFrame(rows, columns=names)).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
                yield plain(pd.DataFrame(rows, columns=names)).astype({"payload_bytes": "Int64"})

    return run


def entries(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record, of any type, of the .warc.gz files that ``path`` names, whoever
    wrote them (``ENTRY``): file, place in it, headers, and bytes and SHA-256 of the
    payload, which of revisits are null; the payload itself if asked for.

    A file is a task's and is in memory as it is stored, so it may have 2 GB at most
    (the limit of Spark's reader of whole files); of its records one is unpacked at a
    time.  Damage is an error; headers that a record doesn't have are null."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_entries(payloads), ENTRY)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes each archive as a .warc.gz file into a folder that the driver sees,
    segment by segment; of no segments, none."""
    made: list[str] = []
    out = None
    for r in archives.orderBy("archive", "seq").toLocalIterator():
        name = f"{folder.rstrip('/')}/{r.archive:05d}.warc.gz"
        if not made or made[-1] != name:
            if out:
                out.close()
            made.append(name)
            out = open(name, "wb")  # noqa: SIM115
        out.write(r.data)
    if out:
        out.close()
    return made
