"""A deterministic sharded WARC writer and its reader.

Records are sorted by page id into key ranges whose bounds depend on the data
alone. Each range is one task's work: it makes headers and digests from the
payloads, writes one gzip member a record, rolls files by compressed size and
commits each file by renaming it from a name of the attempt. The list of
committed files (the manifest) is a written table; readers open only what it
lists, so what a lost executor left behind is never read.

Of records with equal payloads of at least ``dedup_bytes`` bytes the one with
the largest page id is a ``response``; the others are ``revisit`` records that
name it and carry no payload. The same input gives the same bytes: record ids
are UUIDs made from page id and digest, and the date is a parameter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.common import materialize, range_numbers, read_table
from tabaudit.llm.files import open_store, shared_folder

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
DEDUP_BYTES = 1000
#: Uncompressed bytes that a key range is to have, and compressed bytes at which a file is closed.
RANGE_BYTES = 32 << 20
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
#: Distinct repeated payloads (60 bytes each) up to which their list is broadcast.
BROADCAST_ROWS = 500_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def header_text(value: str) -> str:
    """A header value on one line: control characters and spaces percent-coded."""
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                revisit: bool, date: str = DATE) -> bytes:
    """The bytes of one record before compression."""
    sha = hashlib.sha1(payload)
    digest = "sha1:" + base64.b32encode(sha.digest()).decode()
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, sha.hexdigest())),
            ("WARC-Date", date), ("WARC-Payload-Digest", digest),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if url is not None:
        head.append(("WARC-Target-URI", header_text(url)))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha.hexdigest())),
                 ("Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"\r\n".join([VERSION, *[f"{k}: {v}".encode() for k, v in head]])
    return lines + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream):
    """(headers, block) of every record of an open, decompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


MANIFEST = "range_no int, roll int, path string, records long, bytes long, sha1 string, first_page_id long, last_page_id long"


def mark_revisits(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, html) with ``keep``: the page id of the response that a
    record with an equal payload must name, NULL where there is none. Rows that
    repeat the largest page id are responses all; a NULL id is below all."""
    groups = (pages.where(F.octet_length("html") >= dedup_bytes).groupBy(F.sha1("html").alias("digest"))
              .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    groups = materialize(groups, "warc-groups")
    side = F.broadcast(groups) if groups.count() <= broadcast_rows else groups
    digest = F.when(F.octet_length("html") >= dedup_bytes, F.sha1("html"))
    return pages.withColumn("digest", digest).join(side, "digest", "left").drop("digest")


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               dedup_bytes: int = DEDUP_BYTES, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES,
               date: str = DATE) -> DataFrame:
    """Write every row of ``pages`` as a record; returns the manifest. A NULL
    html is an empty payload, a NULL url leaves the target out; NULL ids come
    first; repeated rows are records each; other columns are not read. An
    empty table writes no file."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // range_bytes))
    marked = mark_revisits(range_numbers(rows, "page_id", n, "range_no"), dedup_bytes)
    # what is shuffled: a revisit's payload is still needed for its own digest and headers
    ranged = marked.repartitionById(n, F.col("range_no")).sortWithinPartitions(
        "range_no", F.col("page_id").asc_nulls_first(), "url", "html")

    def write(batches):
        store, attempt, done = open_store(folder), uuid.uuid4().hex, []
        out = None
        number, roll = -1, 0

        def finish():
            out["sink"].close()
            final = f"range-{number:06d}-{roll:04d}.warc.gz"
            store.commit(out["name"], final)
            done.append((number, roll, final, out["n"], out["bytes"], out["sha"].hexdigest(), out["first"], out["last"]))

        for batch in batches:
            for r, pid, u, text, keep in zip(*(batch.column(i) for i in range(5))):
                r, pid, keep = r.as_py(), pid.as_py(), keep.as_py()
                if out is not None and (r != number or out["bytes"] >= file_bytes):
                    finish()
                    roll = roll + 1 if r == number else 0
                    out = None
                if out is None:
                    roll = roll if r == number else 0
                    number = r
                    name = f"_tmp-{attempt}-{number:06d}-{roll:04d}"
                    out = {"name": name, "sink": store.create(name), "n": 0, "bytes": 0, "sha": hashlib.sha1(),
                           "first": pid, "last": pid}
                revisit = keep is not None and pid != keep
                raw = make_record(pid, u.as_py(), text.as_py().encode(), keep, revisit, date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out["sink"].write(member)
                out["sha"].update(member)
                out.update(n=out["n"] + 1, bytes=out["bytes"] + len(member), last=pid)
        if out is not None:
            finish()
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done), kinds)],
                names=["range_no", "roll", "path", "records", "bytes", "sha1", "first_page_id", "last_page_id"])

    return materialize(ranged.select("range_no", "page_id", "url", "html", "keep").mapInArrow(write, MANIFEST),
                       "warc-manifest")


RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, record_id string, path string")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record of the listed files: page_id, url, payload_bytes,
    payload_digest (lower-case hex), record_type, refers_to, record_id, path.
    Digests of blocks and payloads are computed anew and must agree."""
    def read(batches):
        store = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open(name) as source, gzip.GzipFile(fileobj=source) as plain:
                    for headers, block in read_records(io.BufferedReader(plain, 1 << 20)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block differs from its digest")
                        kind = headers["WARC-Type"]
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if digest != said:
                                raise ValueError(f"{name}: a payload differs from its digest")
                        else:
                            size, digest = int(http.rpartition(b"Content-Length: ")[2]), said
                        number = [int(headers[k]) if k in headers else None for k in ("Page-ID", "Refers-To-Page-ID")]
                        rows.append((number[0], headers.get("WARC-Target-URI"), size, digest, kind, number[1],
                                     headers["WARC-Record-ID"], name))
                        if len(rows) >= 5000:
                            yield _record_batch(rows)
                            rows = []
                if rows:
                    yield _record_batch(rows)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    manifest = write_warc(read_table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the read-back must give, from the pages alone.
ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000"""
