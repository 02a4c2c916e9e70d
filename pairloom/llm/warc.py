"""WARC archives: a writer with revisit records, and a salvage reader.

Pages become response records, or revisits of the response with an equal payload; each record is one gzip member. The
reader takes any byte range of an archive: it starts at the first valid record at or after the range's start and reads
every record that starts in the range. A record is valid if its member inflates (length and CRC), its version line,
headers and content length hold, and its digests, if given, agree. After a failed check the reader searches for the next
gzip member or version line that starts a valid record, recovers from there on, and logs the bytes between as a
quarantined gap with the reason.

A member may hold several records: each is read, what is bad between them is a gap within the member (inner, inner_stop:
its place in the inflated bytes). Of a member that stops inflating, or whose CRC fails, the records before the damage are
recovered if their own block digest vouches for them; the gap starts where inflating broke off.

Defined results: null html is an empty payload; null urls have no target header; repeated rows of the winning page_id are
responses all; null page_ids count as the smallest, and such a page has no number when read back; archives without any
valid record are one gap; empty tables give empty results; other columns are not looked at. A record is held in memory
whole, so the longest one sets what a worker needs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, map_pandas, materialize, scratch
from .token_files import opened

SPLIT_BYTES, FILE_BYTES, LEVEL = 32 << 20, 256 << 20, 3
#: Least and most bytes asked of a store at once.
READ_BYTES = 1 << 20
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
EITHER = re.compile(re.escape(MEMBER) + b"|" + re.escape(VERSION))
#: The longest headers of a record.
HEADER_BYTES = 1 << 24
#: The longest name or comment in the header of a gzip member.
NAME_BYTES = 1 << 14
RECORD = "file string, start long, stop long, type string, id string, refers_to string, uri string, headers map<string,string>, block binary, problem string, inner long, inner_stop long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, which says the payload's length, and not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&*+,;=%~')}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, keep: the largest page_id among equal payloads (by SHA-1 and length).

    Only digests meet by content; the pages themselves are joined by page_id, so hot payloads do not skew them."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    short = materialize(pages.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n")))
    keep = short.groupBy("sha", "n").agg(F.max("page_id").alias("keep"))
    of_page = short.join(keep, ["sha", "n"]).select(F.col("page_id").alias("p"), "sha", "keep").distinct()
    return pages.join(of_page, F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1("html") == F.col("sha"))).select("page_id", "url", "html", "keep")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives; the manifest (file, bytes, records) names the files of the attempts that counted."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path)
        task, out, name, size, n, files = TaskContext.get(), None, "", 0, 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])
        for batch in batches:
            for page_id, url, html, keep in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name, size, n = f"{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz", 0, 0
                    out, files = store.open_output_stream(f"{path}/{name}", compression=None), files + 1
                kind = "response" if page_id.as_py() == keep.as_py() else "revisit"
                member = gzipped(record(kind, page_id.as_py(), url.as_py(), html.as_py().encode(), keep.as_py()))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    return materialize(map_arrow(with_types(pages), write, "file string, bytes long, records long"))


class Bytes:
    """A window on a file that grows as it is asked and lets go of what lies behind."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.base, self.data = source, size, at, bytearray()

    def upto(self, stop: int) -> bytearray:
        """Data from base on, at least as far as stop or the end of the file."""
        stop = min(stop, self.size)
        have = self.base + len(self.data)
        if stop > have:
            self.source.seek(have)
            self.data += self.source.read(max(stop - have, min(READ_BYTES, self.size - have)))
        return self.data

    def forget(self, before: int) -> None:
        if before - self.base > READ_BYTES:
            del self.data[: before - self.base]
            self.base = before


@dataclass
class Found:
    start: int
    stop: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes | None = None
    problem: str | None = None
    inner: int | None = None
    inner_stop: int | None = None


class Broken(Exception):
    pass


class Short(Broken):
    """The data end before the headers do."""


def begins_member(view: Bytes, at: int) -> bool:
    """If the bytes at a place can be the header of a gzip member, whose names end within NAME_BYTES; else a machine that
    looks for their ends would read on and on."""
    data = view.upto(at + 12 + (1 << 16) + 2 * NAME_BYTES)
    here = at - view.base
    if len(data) < here + 10 or data[here + 3] & 0xE0:
        return False
    flags, here = data[here + 3], here + 10
    if flags & 4:
        here += 2 + int.from_bytes(data[here : here + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            here = data.find(b"\0", here, here + NAME_BYTES) + 1
            if not here:
                return False
    return True


def inflated(view: Bytes, start: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at start as far as it can be read, where that ends, and the problem if not at its end."""
    machine, at, out = zlib.decompressobj(31), start, []
    step = 1 << 11
    while not machine.eof:
        data = view.upto(at + step)
        part = bytes(data[at - view.base : at - view.base + step])
        if not part:
            return b"".join(out), at, "member is cut off"
        before = machine.copy()
        try:
            out.append(machine.decompress(part))
        except zlib.error as e:
            good, size, machine = 0, len(part), before
            while size:  # as far as it goes before the damage
                ahead = machine.copy()
                try:
                    out.append(ahead.decompress(part[good : good + size]))
                    machine, good = ahead, good + size
                except zlib.error:
                    size //= 2
            return b"".join(out), at + good, f"member does not inflate: {e}"
        at += len(part)
        step = min(2 * step, READ_BYTES)
    return b"".join(out), at - len(machine.unused_data), None


def records_in(content: bytes, intact: bool, start: int, stop: int) -> list[Found]:
    """Records of a member's content, and the gaps between them. Without an intact member only a block digest vouches for a record."""
    found: list[Found] = []
    at, gap, reason = 0, None, ""
    while at < len(content):
        try:
            headers, block, length = checked(content, at)
            if not intact and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Broken("nothing vouches for the record of a damaged member")
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            at = content.find(VERSION, at + 1)
            at = len(content) if at < 0 else at
            continue
        if gap is not None:
            found.append(Found(start, stop, problem=reason, inner=gap, inner_stop=at))
            gap = None
        found.append(Found(start, stop, headers, block, None, at, at + length))
        at += length
    if gap is not None:
        found.append(Found(start, stop, problem=reason, inner=gap, inner_stop=at))
    return found


def headed(data: bytes | bytearray, at: int) -> tuple[dict[str, str], int]:
    """Headers of the record that stands in data at a place, and where its block begins. Lines are read one by one and no
    further than the first bad one, so a place that only looks like a record costs no search for an end."""
    stop = at + HEADER_BYTES
    line = data.find(b"\r\n", at, at + len(VERSION) + 3)
    if line < 0:
        raise (Short if len(data) < at + len(VERSION) + 3 and data.startswith(VERSION, at) else Broken)("no version line and headers")
    if not re.fullmatch(rb"WARC/1\.[0-9]", data[at:line]):
        raise Broken("no version line and headers")
    headers: dict[str, str] = {}
    while True:
        start, line = line + 2, data.find(b"\r\n", line + 2, stop)
        if line < 0:
            raise (Short if len(data) < stop else Broken)("no version line and headers")
        if line == start:
            return headers, line + 2
        name, colon, value = data[start:line].decode("utf-8", "replace").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Broken("a header line has no name")
        headers[name.strip().lower()] = value.strip()


def checked(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that stands in data at a place, and its length."""
    headers, begin = headed(data, at)
    if not {"warc-type", "warc-record-id"} <= headers.keys():
        raise Broken("a header that must be there is missing")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", length):
        raise Broken("no content length")
    stop = begin + int(length)
    if stop > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("content length does not hold")
    block = bytes(data[begin:stop])
    claimed = headers.get("warc-block-digest", "")
    if claimed.startswith("sha1:") and claimed[5:] != digest(block):
        raise Broken("block digest differs")
    claimed, http = headers.get("warc-payload-digest", ""), block.find(b"\r\n\r\n")
    if headers.get("warc-type") == "response" and claimed.startswith("sha1:") and http >= 0 and claimed[5:] != digest(block[http + 4 :]):
        raise Broken("payload digest differs")
    return headers, block, stop + 4 - at


def plain_record(view: Bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """The record that stands at start without compression."""
    step = 1 << 10
    while True:
        data = view.upto(start + step)
        at = start - view.base
        whole = view.base + len(data) >= view.size
        try:
            headers, begin = headed(data, at)
        except Short:
            if whole:
                raise
            step *= 2
            continue
        length = headers.get("content-length", "")
        need = begin - at + int(length) + 4 if re.fullmatch(r"[0-9]+", length) else 0
        if start + need > view.size:
            raise Broken("content length does not hold")
        if whole or len(data) - at >= need:
            return checked(data, at)
        step = need


def salvage(source, size: int, start: int = 0, stop: int | None = None) -> Iterator[Found]:
    """Records that start in [start, stop), and the gaps after them. A gap belongs to the range of the record before it
    (of the file's start if there is none), which reads on to the next record; so every byte is accounted for once."""
    stop, at, view = size if stop is None else min(stop, size), start, Bytes(source, size, start)
    gap: int | None = None
    reason = "bytes before the first record"
    held: list[Found] = []  # of a damaged member, whose end is known with the next record
    fresh = start > 0  # in the middle of a file the range before may own what stands first

    def settled(before: int) -> Iterator[Found]:
        """What was held, and the gap that ends before a place."""
        broke = min(gap, before) if gap is not None else before
        for f in held:
            f.stop = broke
            yield f
        held.clear()
        if gap is not None and broke < before and not fresh:
            yield Found(broke, before, problem=reason)

    while at < size:
        data = view.upto(at + len(VERSION))
        here = at - view.base
        found, damage, why = [], None, "neither member nor version line"
        if data.startswith(MEMBER, here):
            content, end, damage = inflated(view, at) if begins_member(view, at) else (b"", at, "member has no whole header")
            found = records_in(content, damage is None, at, end)
            why = damage or (found[0].problem if found else None) or "member is empty"
            if all(f.problem for f in found):
                found = []
        elif data.startswith(VERSION, here):
            try:
                headers, block, length = plain_record(view, at)
                found = [Found(at, at + length, headers, block)]
            except Broken as e:
                why = str(e)
        if not found:
            if gap is None:
                gap, reason = at, why
            if at >= stop and fresh:
                return
            at = sought(view, at + 1)
        else:
            yield from settled(at)
            if at >= stop:
                return
            fresh, gap = False, None
            if damage:  # later members may lie within what was taken for this one
                held += found
                gap, reason = found[0].stop, damage
                at = sought(view, at + 1)
            else:
                yield from found
                at = found[0].stop  # what follows up to the next record is this range's too, even beyond its stop
        view.forget(at)
    yield from settled(size)


def sought(view: Bytes, at: int) -> int:
    """The next place at or after at where a member or version line may start; the end of the file if there is none."""
    while at < view.size:
        data = view.upto(at + READ_BYTES)
        place = EITHER.search(data, at - view.base)
        if place:
            return view.base + place.start()
        at = max(at + 1, view.base + len(data) - len(VERSION) + 1)
        view.forget(at)
        if view.base + len(data) >= view.size and at >= view.size - len(VERSION):
            return view.size
    return view.size


def read_archives(spark: SparkSession, folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records and gaps of the archives named by files (file): rows with a problem are quarantined gaps [start, stop)."""

    def splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(folder)
        for batch in batches:
            sizes = [store.get_file_info(f"{path}/{f}").size for f in batch.file]
            yield pd.DataFrame([(f, a, min(s, a + split_bytes)) for f, s in zip(batch.file, sizes, strict=True) for a in range(0, s, split_bytes)], columns=["file", "a", "b"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(folder)
        angle = lambda v: v.strip("<>") if v else None
        frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"inner": "Int64", "inner_stop": "Int64"})
        for batch in batches:
            for file, a, b in zip(batch.file, batch.a, batch.b, strict=True):
                with store.open_input_file(f"{path}/{file}") as source:
                    rows, held = [], 0
                    for f in salvage(source, source.size(), int(a), int(b)):
                        h = f.headers
                        rows.append((file, f.start, f.stop, h.get("warc-type"), angle(h.get("warc-record-id")), angle(h.get("warc-refers-to")), h.get("warc-target-uri"), h, f.block, f.problem, f.inner, f.inner_stop))
                        held += len(f.block or b"")
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = map_pandas(files.select("file"), splits, "file string, a long, b long").repartition(n, "file", "a")
    return map_pandas(listed, read, RECORD)


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return found.where("problem is not null").select("file", "start", "stop", "problem", "inner", "inner_stop")


def page_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("long")


def page_records(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages, read them back, and say for each what its record is."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    found = read_archives(spark, folder, write_archives(pages, folder)).where("problem is null")
    head = F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)
    length = F.regexp_extract(head, r"(?i)content-length: *([0-9]+)", 1)
    return found.select(
        page_of(F.col("id")).alias("page_id"), length.cast("long").alias("payload_bytes"), F.substring_index(F.element_at("headers", "warc-payload-digest"), ":", -1).alias("payload_digest"),
        F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), "file", "start", "stop",
    )
