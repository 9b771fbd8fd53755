"""Web archives: written with an index, read back by coalesced byte ranges.

Every task writes archives of its own into the shared folder, one gzip member
for each record, and returns an index row for each record: file, offset,
length, address and digest. Reading starts from index rows: they are sorted by
file and offset, neighbours are read in one range, and each record is checked
against its digest. Files of a failed task attempt are in no index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradespark.llm.common import narrow, settled, shared_folder

#: Payloads of at least so many bytes may be replaced by a reference to an equal one.
REVISIT_BYTES = 0
ARCHIVE_BYTES = 256 << 20
#: Records closer than GAP are read together, up to SPAN bytes at once.
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes of archives for one reader.
SPLIT = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, record_type string"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_BATCH = 512


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    tail = urn.rpartition(":")[2].rstrip(">")
    return None if tail == "none" else int(tail)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> tuple[bytes, str]:
    """A record as a gzip member, and its payload digest. A revisit carries headers only."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"), "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        head |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush(), digest


def parse(member: bytes) -> dict:
    """Header fields of a record, its payload and the length of the full payload; a damaged record is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields | {"payload": payload, "size": size, "digest": digest}


def write_archives(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` ``(page_id, url, html)``; returns the index.

    Of equal payloads of at least ``revisit_bytes`` bytes, the one with the smallest
    page_id is a response and the others refer to it. A null html is an empty
    payload, a null url an empty one. A null page_id never is the smallest, unless
    there is no other; rows that repeat the smallest page_id are responses too.
    ``folder`` must be one that all executors share; the default is a new one in
    the session's shared folder. An empty table gives an empty index.
    """
    root = folder or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = narrow(pages, {"page_id": F.col("page_id").cast("bigint"), "url": F.col("url").cast("string"), "html": F.coalesce(F.col("html").cast("string"), F.lit(""))})
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= revisit_bytes, F.sha1(F.col("html").cast("binary"))))
    # One row per payload that occurs more than once; kept, so that the join can split a frequent one.
    heads = rows.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    heads = settled(heads.select(F.col("key").alias("_key"), "first"))
    marked = rows.join(heads, F.col("key") == F.col("_key"), "left").select(
        "page_id", "url", "html", (F.col("_key").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        stem, number, out, at, rows = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, None, 0, []
        try:
            for batch in batches:
                for page_id, url, html, revisit, first in zip(*(c.to_pylist() for c in batch.columns)):
                    data, digest = record(page_id, url, html.encode("utf-8", "replace"), revisit, first)
                    if out is None or at + len(data) > archive_bytes and at:
                        if out is not None:
                            out.close()
                        name, at, number = f"{stem}-{number}.warc.gz", 0, number + 1
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)  # records are compressed already
                    out.write(data)
                    rows.append((name, at, len(data), page_id, url, digest, "revisit" if revisit else "response"))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], [f.split()[0] for f in INDEX.split(", ")])
                    rows = []
        finally:
            if out is not None:
                out.close()

    return settled(marked.mapInArrow(run, INDEX)).withColumn("file", F.concat(F.lit(f"{root}/"), "file"))


def read_records(index: DataFrame, with_payload: bool = False, gap: int = GAP, span: int = SPAN, split: int = SPLIT) -> DataFrame:
    """The records that ``index`` names: page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload].

    Length and digest are those of the full payload, for revisits too; their
    ``payload`` is null. Any selection of index rows may be read; a row given
    twice is read twice. A reader gets about ``split`` bytes of archives, or
    less where the cluster has more cores than there are such shares.
    """
    chosen = index.select("file", "offset", "length", "url")
    # The small index says how much is to be read; its own size would not.
    total = chosen.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    readers = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // split))
    chosen = chosen.repartitionByRange(readers, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems, stream, opened = {}, None, None

        def fetch(rows: list[tuple]) -> Iterator[tuple]:
            nonlocal stream, opened
            file, start = rows[0][0], rows[0][1]
            if file != opened:
                if stream is not None:
                    stream.close()
                root = file.rpartition("/")[0]
                if root not in systems:
                    systems[root] = fs.FileSystem.from_uri(root)
                system, path = systems[root]
                stream, opened = system.open_input_file(f"{path}/{file.rpartition('/')[2]}"), file
            data = stream.read_at(max(r[1] + r[2] for r in rows) - start, start)
            for _, offset, length, url in rows:
                got = parse(data[offset - start : offset - start + length])
                revisit = got["WARC-Type"] == "revisit"
                yield (_page(got["WARC-Record-ID"]), got["size"], got["digest"], got["WARC-Type"], _page(got["WARC-Refers-To"]) if revisit else None,
                       url, None if revisit else got["payload"])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
            keep = 7 if with_payload else 5
            return pa.RecordBatch.from_arrays(columns[:keep], names[:keep])

        try:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    far = held and (row[0] != held[0][0] or row[1] > held[-1][1] + held[-1][2] + gap or row[1] + row[2] - held[0][1] > span or len(held) >= _BATCH)
                    if far:
                        yield batch_of(list(fetch(held)))
                        held = []
                    held.append(row)
            if held:
                yield batch_of(list(fetch(held)))
        finally:
            if stream is not None:
                stream.close()

    return chosen.mapInArrow(run, RECORD + ", url string, payload binary" * with_payload)


ORACLE = """
with p as (select page_id, coalesce(html, '') as body from pages),
q as (select page_id, octet_length(encode(body)) as size, sha1(encode(body)) as hex from p),
d as (
  select page_id, cast(size as bigint) as payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(hex, cast(5 * (i // 4) + 1 as bigint), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31) as bigint), 1)),
    'string_agg', '') as payload_digest
  from q
), f as (select *, min(page_id) over (partition by payload_digest) as head from d)
select page_id, payload_bytes, payload_digest, case when page_id = head then 'response' else 'revisit' end as record_type,
  case when page_id <> head then head end as refers_to
from f
"""
