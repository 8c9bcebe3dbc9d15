"""WARC archives: written with an index, read by coalesced byte ranges.

Writing: each Spark task appends records, each a gzip member of its own, to an
archive in the shared folder and returns the index row of every record: file,
offset, length, URL, digest. The index is a Parquet table that Spark commits;
an archive that a lost task left half-written is in no index row, since a new
attempt takes a new file name. Of records with equal payloads (by SHA-1 and
length) that with the largest id is a ``response``, the others ``revisit`` it
and hold HTTP headers only.

Reading: index rows are selected first. Those of a file are sorted by offset
and neighbours are coalesced while the gap between them is small and the range
has less than ``range_bytes``; each range is one read, its records are cut out
and parsed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blotter.llm.common import materialize, scratch_path

INDEX = ("file string, offset long, length long, url string, digest string, id long, record_type string, refers_to long")
ROLL_BYTES = 256 << 20  # size at which a task begins a new archive
LEVEL = 3  # of gzip


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs, ...) or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _target(url: str) -> str:
    """A URL for a header line: signs that could end the line are escaped."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; without payload, a revisit."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _target(url).encode())
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}".encode())
    head.append(f"WARC-Payload-Digest: sha1:{digest}".encode())
    if revisit:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>".encode())
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives of all rows in ``folder``/archives; returns their index, a written table.

    Equal payloads of less than ``min_bytes`` bytes are all responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # a row's number tells repeated rows apart, so that one of them is the response; it is
    # stored, since the two reads below need not number rows alike
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("sha1", F.sha1("payload")), "numbered", compression="zstd")
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.concat_ws(":", "sha1", F.octet_length("payload"))))
    first = rows.groupBy("key").agg(F.max(F.struct("id", "row")).alias("first")).where("key is not null").withColumnRenamed("key", "first_key")
    # a hash join: payloads are dealt out by key but never sorted
    met = rows.join(first.hint("shuffle_hash"), F.col("key") == F.col("first_key"), "left")
    named = met.select("id", "url", "sha1", F.octet_length("payload").cast("long").alias("size"), F.col("first.id").alias("refers_to"),
                       (F.col("first.row") != F.col("row")).alias("again"), "payload")
    named = named.withColumn("payload", F.when(~F.coalesce("again", F.lit(False)), F.col("payload")))
    archives = f"{folder}/archives"

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(archives)
        store.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None or at > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                digest, revisit = base32_sha1(r["sha1"]), r["payload"] is None
                data = gzip.compress(record(r["id"], r["url"], r["payload"], r["size"], digest, r["refers_to"] if revisit else None), LEVEL, mtime=0)
                out.write(data)
                index.append({"file": name, "offset": at, "length": len(data), "url": r["url"], "digest": digest, "id": r["id"],
                              "record_type": "revisit" if revisit else "response", "refers_to": r["refers_to"] if revisit else None})
                at += len(data)
            if index:
                yield pa.RecordBatch.from_pylist(index, pa.schema([
                    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
                    ("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if out is not None:
            out.close()

    path = f"{folder}/index"
    named.mapInArrow(append, INDEX).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def ranges(index: DataFrame, max_gap: int = 64 << 10, range_bytes: int = 8 << 20) -> DataFrame:
    """``(file, start, stop, records)`` of selected index rows: sorted neighbours
    in one range. Windows are per archive, whose size is bounded."""
    order = W.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.expr("offset + length")).over(order)
    far = index.select("file", "offset", "length", F.coalesce((gap > max_gap).cast("int"), F.lit(1)).alias("far"))
    part = far.withColumn("run", F.sum("far").over(order)).withColumn("cell", F.floor(F.col("offset") / range_bytes))
    return part.groupBy("file", "run", "cell").agg(
        F.min("offset").alias("start"), F.max(F.expr("offset + length")).alias("stop"),
        F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))


READ = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(index: DataFrame, folder: str, with_payload: bool = True, **coalesce) -> DataFrame:
    """Records of the selected index rows, from ``folder``: ``READ``'s columns.

    ``payload_bytes`` is the full payload's, also of a revisit; a response whose
    payload doesn't have its digest raises.
    """
    archives = f"{folder}/archives"

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(archives)
        for frame in frames:
            for r in frame.itertuples(index=False):
                with store.open_input_file(f"{base}/{r.file}") as f:
                    data = f.read_at(r.stop - r.start, r.start)
                out = []
                for x in r.records:
                    at = x["offset"] - r.start
                    head, http, payload = parse(gzip.decompress(data[at:at + x["length"]]))
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{r.file} at {x['offset']}: the payload doesn't have its digest")
                    refers = re.search(r"<urn:page:(-?\d+)>", head.get("WARC-Refers-To", ""))
                    target = head.get("WARC-Target-URI")
                    out.append((int(head["WARC-Page-ID"]) if "WARC-Page-ID" in head else None,
                                None if target is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), target) if "%" in target else target,
                                payload if with_payload and kind == "response" else None,
                                int(http["Content-Length"]), digest, kind, int(refers[1]) if refers else None))
                cols = [c.split()[0] for c in READ.split(", ")]
                yield pd.DataFrame(out, columns=cols).astype({c: "Int64" for c in ("id", "payload_bytes", "refers_to")})

    # an index row is small but its record isn't: ranges are dealt to all tasks
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges(index, **coalesce).repartition(tasks, "file", "start").mapInPandas(parsed, READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all rows, read all records back; one row per record: id,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Null payloads are empty ones, null URLs have no target header. A null id is
    smaller than any other; a revisit of a record without id refers to null. Of
    rows that repeat an id and payload, one is the response. An empty table
    gives an empty result; other columns are ignored.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    index = write(pages, folder, id_col, url_col, payload_col, min_bytes)
    back = read(index, folder, with_payload=False)
    return back.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The round trip's result in DuckDB's SQL: five hex digits are four of base 32.
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('{_CHARS}',
         ((CAST('0x' || substr(hex, CAST(j // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - j % 4 * 5 AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
FROM p
"""
