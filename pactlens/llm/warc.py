"""WARC archives: a writer with revisit records and a salvage reader (operator 6).

The writer makes gzip members of one record each, and files of a bounded size. Of records with equal payloads the one with the
smallest id is a response, the others revisit it. The reader checks every record: the member's CRC, the version line, the block's
length and end, the block's and the payload's SHA-256. After a failed check it searches for the next gzip member (in a plain file:
the next version line) that holds a valid record, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, by_bytes, read_blobs, ship, write_blobs

#: Compressed bytes after which the writer begins a new file; a file holds one record at least.
FILE_BYTES = 4 << 20
#: Payloads below this many bytes are stored each time.
MIN_REVISIT_BYTES = 100
#: Compressed bytes given to the decompressor at a time.
CHUNK = 16 << 10
#: Rows of the table of repeated payloads up to which it is broadcast (about 100 bytes a row).
BROADCAST_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member. Members may be concatenated, so a .warc.gz file may end with it; its bytes are written as Latin-1.
EMPTY_MEMBER = gzip.compress(b"", 9, mtime=0).decode("latin-1")
GZIP_START, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
#: What ends a header: an empty line, or, in a damaged one, the next version line, so that no search runs over records to come.
HEADER_END = re.compile(rb"\r\n(?:\r\n|(?=WARC/1\.[01]\r\n))")
GAP_FIELDS = "file string, gap_start long, gap_end long, reason string"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def urn_of(page: str | None) -> str:
    return "<urn:nil>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One uncompressed record; ids are percent-encoded into URNs. refers_to: the page that a revisit points to."""
    block = http_head(len(payload)) + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", urn_of(page)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn_of(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Found:
    """A valid record, or a gap [start, end) of the file and why it was left out."""

    start: int
    end: int
    fields: dict[str, str] | None = None
    payload: bytes | None = None
    payload_bytes: int = 0
    reason: str = ""


class Damaged(Exception):
    pass


class LostRecords(RuntimeError):
    """An archive of our own did not give back what was written into it."""


def parse(data: bytes, at: int) -> Found:
    """The record whose version line begins at `at`."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    end_of_header = HEADER_END.search(data, at)
    if not end_of_header or end_of_header.end() - end_of_header.start() < 4:
        raise Damaged("the header has no end")
    body = end_of_header.start()
    lines = data[at:body].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line has no colon")
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no valid Content-Length")
    start = body + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where Content-Length says")
    block = data[start:end]
    if (d := fields.get("warc-block-digest", "")).startswith("sha256:") and hashlib.sha256(block).hexdigest() != d[7:]:
        raise Damaged("block digest")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if fields.get("warc-type") == "revisit":
            said = re.search(rb"(?im)^content-length:\s*([0-9]+)", head)
            size = int(said[1]) if said else 0
    if fields.get("warc-type") == "response" and (d := fields.get("warc-payload-digest", "")).startswith("sha256:") and hashlib.sha256(payload).hexdigest() != d[7:]:
        raise Damaged("payload digest")
    return Found(at, end + 4, fields, payload, size)


def salvage_plain(data: bytes) -> Iterator[Found]:
    """Records and gaps of uncompressed bytes, in order and without overlap."""
    at = lost = 0
    why = ""
    while at < len(data):
        try:
            found = parse(data, at)
        except Damaged as e:
            why = why or str(e)
            later = VERSION.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if lost < at:
            yield Found(lost, at, reason=why)
        yield found
        at = lost = found.end
        why = ""
    if lost < len(data):
        yield Found(lost, len(data), reason=why)


def salvage_gzip(data: bytes) -> Iterator[Found]:
    """The same of gzip members; places count in the compressed file. A member's good records are kept where others of it are damaged."""
    at = lost = 0
    why, view = "", memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            if data[at : at + 3] != GZIP_START:
                raise Damaged("no gzip member")
            parts, end = [], at
            while not member.eof and end < len(data):
                parts.append(member.decompress(view[end : end + CHUNK]))
                end = min(end + CHUNK, len(data))
            if not member.eof:
                raise Damaged("the member is cut short")
            plain, end = b"".join(parts), end - len(member.unused_data)
            inside = list(salvage_plain(plain))
            if plain and not any(x.fields for x in inside):
                raise Damaged(inside[0].reason)
        except (zlib.error, Damaged) as e:
            why = why or ("the member is damaged" if isinstance(e, zlib.error) else str(e))
            at = later if (later := data.find(GZIP_START, at + 1)) >= 0 else len(data)
            continue
        if lost < at:
            yield Found(lost, at, reason=why)
        for x in inside:
            yield Found(at, end, x.fields, x.payload, x.payload_bytes, x.reason and f"inside the member: {x.reason}")
        at = lost = end
        why = ""
    if lost < len(data):
        yield Found(lost, len(data), reason=why)


def salvage(data: bytes) -> Iterator[Found]:
    """Of either kind of file: gzip if the first version line comes after the first sign of a member, or there is none."""
    sign, line = data.find(GZIP_START), VERSION.search(data)
    return salvage_gzip(data) if sign >= 0 and not (line and line.start() < sign) else salvage_plain(data)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES, stage: Stage | None = None) -> None:
    """A record for each row, in files of about file_bytes. Null payloads count as empty, null urls are left out.

    Rows with the same id and payload are alike, all responses or all revisits; a null id comes after all others. Only the three
    columns are read. Payloads are never shuffled: the table of repeated payloads (digest and first id) is broadcast as long as
    it is small, and only beyond that do pages go to their digests.
    """
    spark = pages.sparkSession
    ship(spark)
    stage = stage or Stage(spark, "warc")
    payload = F.coalesce(F.encode(pages[payload_col], "UTF-8"), F.lit(b""))
    rows = pages.select(pages[id_col].alias("__id"), pages[url_col].alias("__url"), payload.alias("__payload")).withColumn("__digest", F.sha2("__payload", 256))
    large = rows.filter(F.octet_length("__payload") >= MIN_REVISIT_BYTES)
    repeated = large.groupBy("__digest").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    repeated = stage.table(repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated.withColumnRenamed("__digest", "__of"), (F.col("__digest") == F.col("__of")) & (F.octet_length("__payload") >= MIN_REVISIT_BYTES), "left")
    again = F.col("__first").isNotNull() & (F.col("__id").isNull() | (F.col("__id") > F.col("__first")))
    ready = joined.select(F.col("__id").cast("string").alias("id"), "__url", "__payload", "__digest", F.when(again, F.col("__first").cast("string")).alias("refers_to"))

    def run(batches):
        held: list[bytes] = []
        size = 0
        for b in by_bytes(batches, "__payload"):
            for page, url, body, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(5))):
                member = gzip.compress(record(page, url, body, digest, refers_to), 6, mtime=0)
                if held and size + len(member) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])

    write_blobs(ready.mapInArrow(run, "file binary"), path, end=EMPTY_MEMBER)
    stage.drop("repeated")


def read_warc(files: DataFrame) -> DataFrame:
    """All records and gaps of (path, content) rows, as read_blobs or Spark's binaryFile source gives them.

    A record has record_type, page and refers_to (decoded from its URNs; null for other ids), url, payload (empty for a revisit),
    payload_bytes and payload_digest of the full payload, and a null gap_start. A gap has file, gap_start, gap_end and reason only.
    Files without bytes give no rows; null contents count as empty.
    """
    ship(files.sparkSession)
    names = ["record_type", "page", "refers_to", "url", "payload", "payload_bytes", "payload_digest", "file", "gap_start", "gap_end", "reason"]

    def urn(text: str | None) -> str | None:
        return unquote(text[10:-1]) if text and text.startswith("<urn:page:") else None

    def run(batches):
        types = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for x in salvage(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    if x.fields is None:
                        rows.append((None,) * 7 + (path.as_py(), x.start, x.end, x.reason))
                        continue
                    f = x.fields
                    kind = f.get("warc-type")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(x.payload).hexdigest()
                    url = f.get("warc-target-uri")
                    rows.append((kind, urn(f.get("warc-record-id")), urn(f.get("warc-refers-to")), url, x.payload, x.payload_bytes, digest, path.as_py(), None, None, None))
                    size += len(x.payload)
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    ddl = "record_type string, page string, refers_to string, url string, payload binary, payload_bytes long, payload_digest string, " + GAP_FIELDS
    return files.select("path", "content").mapInArrow(run, ddl)


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages' archives into the shared folder and read them back; as read_warc, with the ids in id_col's type.

    What is read is lazy and may hold gaps; archived_records() makes sure that nothing is lost.
    """
    return _archived(pages, Stage(pages.sparkSession, "warc"), id_col, url_col, payload_col)


def _archived(pages: DataFrame, stage: Stage, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    write_warc(pages, stage.at("archive"), id_col=id_col, url_col=url_col, payload_col=payload_col, stage=stage)
    kind = pages.schema[id_col].dataType
    read = read_warc(read_blobs(pages.sparkSession, stage.at("archive")))
    return read.withColumn("page", F.col("page").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archived_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The records of archive() without their payloads, as many as there are pages, or an error: see all_of()."""
    stage = Stage(pages.sparkSession, "warc")
    return all_of(_archived(pages, stage, id_col, url_col, payload_col), pages.count(), stage)


def all_of(read: DataFrame, rows: int, stage: Stage) -> DataFrame:
    """The records of read_warc() without payloads, read once into a table; LostRecords if there is a gap or there are not `rows` records.

    An archive without files has no records, which is right for no rows.
    """
    table = stage.table(read.drop("payload"), "records")
    gap = F.col("gap_start").isNotNull()
    seen = table.agg(F.count_if(~gap).alias("records"), F.count_if(gap).alias("gaps"), F.min(F.when(gap, F.struct("file", "gap_start", "gap_end", "reason"))).alias("first")).first()
    if seen.gaps or seen.records != rows:
        raise LostRecords(f"{rows} records written, {seen.records} read, {seen.gaps} gaps" + (f", one in {seen.first.file}: {seen.first.reason}" if seen.gaps else ""))
    return table.filter(~gap)
