"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The reader goes from record to record. After a failed check (a gzip member that doesn't inflate to its own checksum, a
header without version line, mandatory fields or length, header lines other than printable ``name: value``, a header or a
block that isn't what its digest says) it searches for the next gzip member or version line from which a whole record can
be read, goes on there, and reports the bytes between as a quarantined gap. A plain record has no checksum but its digests,
so the writer adds one of the header lines. The reader reads in steps and holds one record at a time; its limit, ``MOST``
bytes, is above what a value of Spark's can hold, so no record that was written from a table is beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialise, opened, scratch, spread, text_key

STEP, MOST = 1 << 20, (1 << 31) + (1 << 20)
HEAD = 1 << 20  # a header that has not ended by then is damaged
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEAL = b"WARC-X-Header-Digest: sha1:"  # over the version line and all header lines before it
LINE = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+): ?([^\x00-\x08\x0a-\x1f\x7f]*)")
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, not compressed; a revisit's block has the HTTP header only, whose length is the full payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    lines = "\r\n".join(head).encode()
    return lines + b"\r\n" + SEAL + base32_sha1(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    """A gzip member, the same bytes each time."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Record(NamedTuple):
    at: int  # of its first byte in the archive
    headers: dict[str, str]  # names in lower case
    block: bytes

    def payload(self) -> bytes:
        """What follows the HTTP header, or all of the block where there is none."""
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("content-type", "") else self.block

    def http_length(self) -> int | None:
        m = re.search(rb"(?im)^content-length:\s*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(m[1]) if m else None


class Gap(NamedTuple):
    at: int
    size: int
    why: str


class Damaged(Exception):
    pass


def parse_head(raw: bytes) -> tuple[dict[str, str], int, int]:
    """Headers (names in lower case), where the block starts, and its length, of the record at the start of raw."""
    if not re.match(rb"WARC/1\.[01]\r\n", raw):
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", 0, HEAD)
    if end < 0:
        raise Damaged("its header does not end")
    lines, seal, told = raw[:end].partition(b"\r\n" + SEAL)
    if seal and told.decode("latin-1") != base32_sha1(lines):
        raise Damaged("its header's digest differs")
    headers = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        if not (m := LINE.fullmatch(line)):
            raise Damaged("a header line that is no name and value")
        headers[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
    if lacking := [x for x in NEEDED if not headers.get(x)]:
        raise Damaged(f"no {lacking[0]}")
    if not re.fullmatch("[0-9]+", headers["content-length"]):
        raise Damaged("its length is no number")
    return headers, end + 4, int(headers["content-length"])


def checked(headers: dict[str, str], rest: bytes, n: int) -> bytes:
    """The block of n bytes that rest starts with, if it ends as it should and is what its digest says."""
    if rest[n : n + 4] != b"\r\n\r\n":
        raise Damaged("it has another length than its header says")
    block = rest[:n]
    if (digest := headers.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise Damaged("its digest differs")
    return block


class Salvage:
    """Iterates over the records and gaps of an archive with size() and read_at(n, at)."""

    def __init__(self, file, most: int = MOST) -> None:
        self.file, self.size, self.most = file, file.size(), most

    def _member(self, at: int) -> tuple[Record, int]:
        z, out, got, pos = zlib.decompressobj(31), [], 0, at
        while not z.eof:
            chunk = self.file.read_at(min(STEP, self.size - pos), pos) if pos < self.size else b""
            if not chunk:
                raise Damaged("the archive ends within a member")
            pos += len(chunk)
            while chunk and not z.eof:
                try:
                    part = z.decompress(chunk, self.most - got + 1)
                except zlib.error as e:
                    raise Damaged(f"its member doesn't inflate: {e}") from None
                if not got and not out and part and not part[:7].startswith(VERSION[: min(7, len(part))]):
                    raise Damaged("no version line")
                out.append(part)
                got += len(part)
                if got > self.most:
                    raise Damaged("it is too large")
                chunk = z.unconsumed_tail
        raw = b"".join(out)
        headers, start, n = parse_head(raw)
        if len(raw) != start + n + 4:
            raise Damaged("its member has another length than its header says")
        return Record(at, headers, checked(headers, raw[start:], n)), pos - len(z.unused_data)

    def _plain(self, at: int) -> tuple[Record, int]:
        raw = self.file.read_at(min(HEAD, self.size - at), at)
        headers, start, n = parse_head(raw)
        size = start + n + 4
        if size > min(self.most, self.size - at):
            raise Damaged("it is longer than the archive, or too large")
        if size > len(raw):
            raw += self.file.read_at(size - len(raw), at + len(raw))
        return Record(at, headers, checked(headers, raw[start:size], n)), at + size

    def _record(self, at: int) -> tuple[Record, int]:
        start = self.file.read_at(min(8, self.size - at), at)
        if start.startswith(MEMBER):
            return self._member(at)
        if start.startswith(VERSION):
            return self._plain(at)
        raise Damaged("neither a member nor a version line")

    def _next(self, at: int) -> int:
        """The next place from at on where a member or a version line may start; the end if there is none."""
        while at < self.size:
            raw = self.file.read_at(min(STEP + 8, self.size - at), at)
            if m := re.search(rb"\x1f\x8b\x08|WARC/1\.", raw):
                return at + m.start()
            if at + len(raw) >= self.size:
                break
            at += STEP
        return self.size

    def __iter__(self) -> Iterator[Record | Gap]:
        at, gap, why = 0, None, ""
        while at < self.size:
            try:
                found, after = self._record(at)
            except Damaged as e:
                if gap is None:
                    gap, why = at, str(e)
                at = self._next(at + 1)
                continue
            if gap is not None:
                yield Gap(gap, at - gap, why)
                gap = None
            yield found
            at = after
        if gap is not None:
            yield Gap(gap, self.size - gap, why)


def write_warc(pages: DataFrame, folder: str | None = None, most: int = 64 << 20) -> DataFrame:
    """Writes a record per page in gzip members to archives of about most bytes; returns a row an archive: file, records.

    Of equal payloads the page with the largest id is the response, smaller ones refer to it. Digests and ids alone decide that:
    counted with partial sums before the shuffle, and only pages that refer to another are joined back. Defined cases: a null
    html is an empty payload; a null url has no target; a null page_id is always a response, named ``none``; an empty table
    makes no archive; other columns are ignored.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    marks = rows.select("page_id", text_key(F.col("html")).alias("text_key"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    # written, so that both sides of the join are plain shuffles, whose hot keys (empty payloads) can be split
    groups = materialise(marks.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-groups")
    refer = marks.join(groups, "digest").where("page_id < refers_to").select("page_id", "text_key", "refers_to").distinct()
    told = rows.withColumn("text_key", text_key(F.col("html"))).join(refer, ["page_id", "text_key"], "left").select("page_id", "url", "html", "refers_to")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out, size, records, done = TaskContext.get().partitionId(), None, 0, 0, []
        for frame in frames:
            ids, refs = frame["page_id"].astype("Int64"), frame["refers_to"].astype("Int64")
            for page_id, url, html, ref in zip(ids, frame["url"], frame["html"], refs):
                if out is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    fs, at = opened(name)
                    fs.create_dir(at.rpartition("/")[0])
                    out, size, records = fs.open_output_stream(at, compression=None), 0, 0
                raw = member(record(None if page_id is pd.NA else int(page_id), url, html.encode(), None if ref is pd.NA else int(ref)))
                out.write(raw)
                size, records = size + len(raw), records + 1
                if size >= most:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pd.DataFrame(done, columns=["file", "records"])

    return materialise(told.mapInPandas(run, "file string, records long"), "warc-list")


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of archives (column file): file, offset, gap_bytes and gap_reason of gaps; of records page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response whose payload isn't what its digest says is a gap too. A revisit's bytes and digest are the full payload's.
    Defined cases: an archive of no bytes has no rows; one that holds no record is one gap; a table of no files gives no rows.
    """
    names = ["file", "offset", "gap_bytes", "gap_reason", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    schema = "file string, offset long, gap_bytes long, gap_reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def rows(name: str) -> Iterator[tuple]:
        fs, at = opened(name)
        with fs.open_input_file(at) as f:
            for x in Salvage(f):
                if isinstance(x, Gap):
                    yield name, x.at, x.size, x.why, *[None] * 7
                    continue
                kind, payload = x.headers.get("warc-type"), x.payload()
                says = x.headers.get("warc-payload-digest", "").rpartition(":")[2]
                if kind == "revisit":
                    size, digest, payload = x.http_length(), says or None, b""
                else:
                    size, digest = len(payload), base32_sha1(payload)
                    if says and says != digest:
                        yield name, x.at, len(x.block), "its payload's digest differs", *[None] * 7
                        continue
                yield name, x.at, None, None, page_of(x.headers.get("warc-record-id")), x.headers.get("warc-target-uri"), kind, page_of(x.headers.get("warc-refers-to")), size, digest, payload if with_payload else None

    def frame(part: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(part, columns=names).astype({c: "Int64" for c in ("offset", "gap_bytes", "page_id", "refers_to", "payload_bytes")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size = [], 0
        for name in (n for f in frames for n in f["file"]):
            for row in rows(name):
                part.append(row)
                size += 200 + len(row[-1] or b"")
                if size > 8 << 20:
                    yield frame(part)
                    part, size = [], 0
        if part:
            yield frame(part)

    return spread(files.select("file")).mapInPandas(run, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes and reads back: one row per input row, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Defined cases: a null html is an empty payload, and empty payloads are equal like others; a null url has no target; a
    null page_id is always a response; rows that share the largest page_id of equal payloads are all responses; an empty table
    makes no archive and gives no rows; other columns are ignored.
    """
    back = read_warc(write_warc(pages), with_payload=False)
    lost = F.raise_error(F.concat(F.lit("an archive just written has a gap: "), F.col("file"), F.lit(" "), F.col("gap_reason"))).cast("long")
    page_id = F.when(F.col("gap_bytes").isNull(), F.col("page_id")).otherwise(lost)
    return back.select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
