import base64
import gzip
import hashlib
import os
import random

import pytest
from blotter.llm import warc
from blotter.llm.common import scratch_path
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, offset long, file string"


def rows_of():
    rnd = random.Random(1)
    rows = [(i, f"http://x.org/{i}", "<p>" + rnd.choice(["a", "é😀", "b\r\n\r\nWARC/1.1\r\n"]) * rnd.randint(0, 50)) for i in range(200)]
    rows += [(1000 + i, "http://y.org/", "the same page") for i in range(300)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://z.org/a b\r\nX: y%20\n", "x" * 3_000_000), (None, "http://n", "no id"), (None, "http://n", "no id"),
             (3000, "u", "twice"), (3000, "u", "twice"), (None, "u", "half"), (7000, "u", "half")]
    rnd.shuffle(rows)
    return [(*r, 1, "f") for r in rows]


def plain(rows):
    first, out = {}, []
    for k, r in enumerate(rows):
        body = (r[2] or "").encode()
        rank = (r[0] is not None, r[0] or 0)
        if body not in first or rank > first[body][0]:
            first[body] = (rank, k)
    for k, r in enumerate(rows):
        body = (r[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = first[body][1]
        out.append((r[0], len(body), digest, "response" if top == k else "revisit", None if top == k else rows[top][0]))
    return out


def test_round_trip_against_brute_force(spark):
    rows = rows_of()
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_rows_are_numbered_once(spark, tmp_path):
    rows = rows_of()
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(html):
        calls.add(1)
        return html
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("html", seen.asNondeterministic()("html"))
    warc.write(pages, str(tmp_path / "w"))
    assert calls.value == len(rows)


def test_payloads_urls_and_selected_reads(spark):
    rows = rows_of()
    folder = scratch_path(spark, "warc")
    index = warc.write(spark.createDataFrame(rows, SCHEMA), folder)
    back = {(r.id, r.url): r for r in warc.read(index, folder).collect() if r.record_type == "response"}
    for r in rows:
        if (r[0], r[1]) in back and r[0] not in (None, 3000):
            assert bytes(back[r[0], r[1]].payload) == (r[2] or "").encode()
    some = index.where("id % 20 = 0")
    assert warc.read(some, folder, max_gap=0, range_bytes=500).count() == some.count()
    whole = warc.ranges(index).count()
    files = os.listdir(folder.removeprefix("file://") + "/archives")
    assert len(files) <= whole <= len(files) + 1
    for f in files:  # every archive is also readable front to back
        data = gzip.decompress(open(f"{folder.removeprefix('file://')}/archives/{f}", "rb").read())
        assert data.startswith(b"WARC/1.1\r\n")


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab", 1, "f"), (2, "u", "ab", 1, "f"), (3, "u", "abcd", 1, "f"), (4, "u", "abcd", 1, "f")]
    folder = scratch_path(spark, "warc")
    index = warc.write(spark.createDataFrame(rows, SCHEMA), folder, min_bytes=3)
    assert {r.id: r.record_type for r in index.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_a_damaged_payload_raises(spark):
    raw = warc.record(1, "u", b"body", 4, "A" * 32, None)
    assert warc.parse(raw)[2] == b"body"
    folder = scratch_path(spark, "warc")
    index = warc.write(spark.createDataFrame([(1, "u", "body", 1, "f")], SCHEMA), folder)
    path = folder.removeprefix("file://") + "/archives/" + index.first().file
    bad = gzip.compress(gzip.decompress(open(path, "rb").read()).replace(b"body", b"b0dy"), warc.LEVEL, mtime=0)
    open(path, "wb").write(bad)
    from pyspark.sql import functions as F
    with pytest.raises(Exception, match="digest"):
        warc.read(index.withColumn("length", F.lit(len(bad)).cast("long")), folder).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
