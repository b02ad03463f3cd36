"""WARC archives by way of a chunked record table.

A payload is a run of rows (record, chunk number, bytes) of bounded size, with the SHA-1
of the payload up to and with that chunk, so that neither writer nor reader ever holds a
whole record: the writer streams chunks into an archive member, the reader streams a
member into chunks. Archives are WARC/1.1, one gzip member for each record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.llm.common import Scratch
from listingspark.llm.files import open_stream, whole_file

#: Bytes of a chunk.
CHUNK = 1 << 20

RECORDS = pa.schema(
    [
        ("record", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("chunk", pa.int64()),
        ("chunks", pa.int64()),
        ("data", pa.binary()),
        ("running_digest", pa.string()),
    ]
)
RECORDS_DDL = (
    "record string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, chunk long, chunks long, data binary, running_digest string"
)


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def pieces(data: memoryview) -> Iterator[memoryview]:
    """Chunks of a payload; one empty chunk for an empty payload."""
    for at in range(0, max(len(data), 1), CHUNK):
        yield data[at : at + CHUNK]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes and the digest of each payload, chunk by chunk."""
    for batch in batches:
        sizes, digests = [], []
        for x in batch.column("html"):
            data = memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")
            sha = hashlib.sha1()
            for part in pieces(data):
                sha.update(part)
            sizes.append(len(data))
            digests.append(base32_sha1(sha))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names, "payload_bytes", "payload_digest"]
        )


def record_chunks(pages: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of planned pages: one row for each chunk of a payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                html = row.column("html")[0]
                data = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                sha = hashlib.sha1()
                head = {n: row.column(n)[0].as_py() for n in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")}
                head["record"] = f"{head['page_id']}-{head['payload_digest']}"
                head["chunks"] = max(1, -(-len(data) // CHUNK))
                for k, part in enumerate(pieces(data)):
                    sha.update(part)
                    rows.append(head | {"chunk": k, "data": bytes(part) if with_data else None, "running_digest": base32_sha1(sha)})
                    held += len(part) + 256
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return pages.mapInArrow(run, RECORDS_DDL)


def plan_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, record_type, refers_to.

    Of the records with one payload the one with the largest page_id is the response; it
    is found with map-side combining, and joined as a table, so that one payload of very
    many pages is a skewed join that Spark splits.
    """
    ddl = "page_id long, url string, html binary, payload_bytes long, payload_digest string"
    measured = pages.mapInArrow(_digests, ddl)
    first = measured.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    first = scratch.table(first.agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1"), "responses")
    out = measured.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return out.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )


def _header(row: dict) -> bytes:
    body = 0 if row["record_type"] == "revisit" else row["payload_bytes"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:record:{quote(row['record'])}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Bytes: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {body}",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:record:{row['refers_to']}-{quote(row['payload_digest'])}>",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the chunk rows of each partition as one archive; returns (archive, records).

    Chunks of a record follow one another, as ``record_chunks`` makes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"archive-{TaskContext.get().partitionId():08d}.warc.gz"
        records = 0
        with whole_file(f"{folder}/{name}") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["chunk"] == 0:
                        member = zlib.compressobj(1, zlib.DEFLATED, 31)
                        out.write(member.compress(_header(row)))
                    if row["record_type"] != "revisit":
                        out.write(member.compress(row["data"]))
                    if row["chunk"] == row["chunks"] - 1:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                        records += 1
        yield pa.RecordBatch.from_pylist([{"archive": name, "records": records}] if records else [], schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    # the list of archives, one small row each, comes to the driver as a commit list does
    return chunks.sparkSession.createDataFrame(chunks.mapInArrow(run, "archive string, records long").collect(), "archive string, records long")


class _Members:
    """The decompressed bytes of an archive, read forward in bounded steps."""

    def __init__(self, stream):
        self.stream, self.held, self.raw, self.member = stream, bytearray(), b"", None

    def fill(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(1 << 16)
            if not self.raw:
                return False
        if self.member is None:
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(self.raw, CHUNK)
        self.raw = self.member.unconsumed_tail or self.member.unused_data
        if self.member.eof:
            self.member = None
        return True

    def header(self) -> dict[str, str] | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                if self.held:
                    raise ValueError("an archive ends within a record")
                return None
        lines = bytes(self.held[:end]).decode().split("\r\n")
        del self.held[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def read_archives(archives: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives; each payload's digest is checked at its end.

    A revisit has one chunk without data; its digest and bytes are those of its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with open_stream(f"{folder}/{name}") as stream:
                    members = _Members(stream)
                    rows: list[dict] = []
                    held = 0
                    while (h := members.header()) is not None:
                        size, revisit = int(h["content-length"]), h["warc-type"] == "revisit"
                        refers = unquote(h["warc-refers-to"])[len("<urn:record:") :].rpartition("-")[0] if revisit else None
                        head = {
                            "record": unquote(h["warc-record-id"])[len("<urn:record:") : -1],
                            "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
                            "url": h.get("warc-target-uri"),
                            "record_type": h["warc-type"],
                            "refers_to": int(refers) if refers else None,
                            "payload_bytes": int(h["x-payload-bytes"]),
                            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
                            "chunks": max(1, -(-size // CHUNK)),
                        }
                        sha = hashlib.sha1()
                        for k in range(head["chunks"]):
                            data = members.take(min(CHUNK, size - k * CHUNK))
                            sha.update(data)
                            digest = head["payload_digest"] if revisit else base32_sha1(sha)
                            rows.append(head | {"chunk": k, "data": data if with_data and not revisit else None, "running_digest": digest})
                            held += len(data) if with_data else 256
                            if held > 4 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                                rows, held = [], 0
                        if not revisit and (digest != head["payload_digest"] or size != head["payload_bytes"]):
                            raise ValueError(f"payload of {head['record']} does not match its digest")
                        if members.take(4) != b"\r\n\r\n":
                            raise ValueError("a record does not end as it should")
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(n).mapInArrow(run, RECORDS_DDL)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each page into the shared folder and returns what is read back.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to), one row for
    each record. Payloads under ``least_bytes`` are always responses.

    Defined results: a null html is an empty payload; a null url has no target header,
    and line ends in a url, which no header can hold, come back as %0D and %0A;
    rows that share the largest page_id of a payload are all responses, and a null
    page_id is never referred to unless all its payload's ids are null, which then are
    responses; repeated rows are records of their own; further columns are not read; an
    empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.col("html"), "utf-8").alias("html"))
    planned = plan_records(rows, scratch, least_bytes)
    archives = write_archives(record_chunks(planned), scratch.folder("archives"))
    back = read_archives(archives, scratch.folder("archives"), with_data=False)
    # the last chunk of a record carries the digest of all of it
    return back.filter("chunk = chunks - 1").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
