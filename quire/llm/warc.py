"""WARC archives: written as gzip members, indexed first, read back by coalesced byte ranges.

Writing. Records are dealt to archives by a hash of their id, url and payload and sorted by them. A task writes each of its
archives under a name of its own and returns the index rows (path, offset, length, url, digest, page_id); only rows of
tasks that end well reach the index, so what a lost executor or a second attempt leaves is never read. A payload moves once:
what a record is (response or revisit) is decided on rows without payloads and sent to the same place ahead of it.

Revisits. Of the records whose payload has the same digest and length, those with the smallest page_id are
responses and the others revisits of it. The smallest id of each digest that occurs twice is a pre-aggregated group-by, written and
joined back, so Spark can split the rows of one very common payload.

Reading. Selected index rows are dealt by ranges of (path, offset), as many as their bytes need at ``TASK_BYTES`` a task, so a task
reads one stretch of an archive or of several; ranges that lie close together are read in one request, up to a bound, and each
record is unpacked and parsed from its bytes. The payload digest of a response is computed anew from the bytes.

Edge cases: a null html is an empty payload; a null url is written as an empty one, line ends in a url are
percent-encoded; very long payloads are one record each; repeated rows with the smallest id are all responses; with no ids at all every record is a
response; an empty table gives an empty archive and index; other columns are ignored, whatever their names. Archives and index
are results and stay; what only leads to them is deleted.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrowtext import chunks
from quire.llm.tables import remove, scratch, settle

END = b"\r\n\r\n"
ARCHIVE_BYTES = 64 << 20
#: Packed bytes that a reading task gets.
TASK_BYTES = 8 << 20
INDEX = "path string, offset bigint, length bigint, url string, digest string, page_id bigint"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def kinds(pages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """page_id, url, key (of the payload), sha1, bytes and refers_to (null: a response), without payloads; and the tables to delete later."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.xxhash64(html).alias("key"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("bigint").alias("bytes"))
    rows = settle(rows.distinct())
    firsts = settle(rows.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "bytes", "first"))
    repeats = F.col("first").isNotNull() & ((F.col("page_id") != F.col("first")) | F.col("page_id").isNull())
    out = rows.join(firsts.hint("merge"), ["sha1", "bytes"], "left").select("page_id", "url", "key", "sha1", "bytes", F.when(repeats, F.col("first")).alias("refers_to"))
    return out, [rows, firsts]


def record(page_id: int | None, url: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def write(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write archives under ``path`` (of about ``archive_bytes`` before they are packed); return it and the index."""
    spark = pages.sparkSession
    path = path or scratch(spark)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    total = pages.select(F.sum(F.octet_length(F.coalesce("html", F.lit(""))) + 700)).first()[0] or 0
    n = max(1, math.ceil(total / archive_bytes))
    system, at = _filesystem(path)
    system.create_dir(at, recursive=True)
    html = F.coalesce("html", F.lit(""))
    bodies = pages.select("page_id", "url", F.xxhash64(html).alias("key"), html.alias("html"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("bigint").alias("refers_to"))
    known, held = kinds(pages)
    ahead = known.select("page_id", "url", "key", F.lit(None).cast("string").alias("html"), "sha1", "bytes", "refers_to")
    both = ahead.unionByName(bodies).withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "key"), F.lit(n)).cast("int"))
    both = both.repartitionById(n, F.col("archive")).sortWithinPartitions("archive", "page_id", "url", "key", F.col("html").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        current, kind = None, None
        for batch in chunks(batches, "html"):
            rows = []
            for page_id, url, _, html, sha1, size, refers_to, archive in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if html is None:  # what the records that follow are
                    kind = (base64.b32encode(bytes.fromhex(sha1)).decode(), size, refers_to)
                    continue
                if archive != current:
                    if out:
                        out.close()
                    current, name, offset = archive, f"{path}/{archive:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    system, at = _filesystem(name)
                    out = system.open_output_stream(at, compression=None)
                link = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                packer = zlib.compressobj(1, wbits=31)
                data = packer.compress(record(page_id, link, *kind, html.encode())) + packer.flush()
                out.write(data)
                rows.append((name, offset, len(data), link, kind[0], page_id))
                offset += len(data)
            yield _batch(rows, INDEX)
        if out:
            out.close()

    index = settle(both.mapInArrow(pack, INDEX))
    remove(spark, *held)
    return path, index


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, types[t]) for n, t in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], pa.schema(fields))


def _filesystem(path: str):
    from pyarrow import fs

    path = re.sub("^(file:)?/+", "file:///", path)  # Hadoop writes file:/x
    return fs.FileSystem.from_uri(path)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, block = record.partition(END)
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, block[: int(headers["content-length"])]


def read(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The records that ``index`` selects: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Ranges with less than ``gap`` bytes between them are read together, up to ``most`` bytes a request.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        run: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, offset, length = row
                if run and (path != run[0][0] or offset - run[-1][1] - run[-1][2] > gap or offset + length - run[0][1] > most):
                    yield run
                    run = []
                run.append(row)
        if run:
            yield run

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for run in runs(batches):
            first = run[0][1]
            if run[0][0] != opened:
                if source:
                    source.close()
                opened = run[0][0]
                system, at = _filesystem(opened)
                source = system.open_input_file(at)
            data = source.read_at(run[-1][1] + run[-1][2] - first, first)
            yield _batch([unpack(data[o - first : o - first + n]) for _, o, n in run], schema)
        if source:
            source.close()

    picked = index.select("path", "offset", "length")
    n = max(1, -(-(picked.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    picked = picked.repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return picked.mapInArrow(load, schema)


def unpack(data: bytes) -> tuple:
    headers, block = parse(zlib.decompress(data, wbits=31))
    head, _, payload = block.partition(END)
    response = headers["warc-type"] == "response"
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else headers["warc-payload-digest"][5:]

    def page(name: str) -> int | None:
        return int(v) if (v := headers.get(name, "")[10:-1]) else None

    return page("warc-record-id"), headers["warc-target-uri"], headers["warc-type"], page("warc-refers-to"), len(payload) if response else size, digest, payload if response else None
