"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings: every window of ``window`` consecutive words of a benchmark item
(an item of fewer words is one window), as ``" w1 w2 ... wn "`` in normalised
bytes. Documents are normalised the same way, many at a time, with a separator
between documents that no test string holds.

Search: test strings are split into classes by length. In a class, m is the
least length and blocks have up to 8 bytes. A hashed shift table tells for each
block how far the next position is at which a test string's first m bytes can
end with it; blocks that occur in none skip m - B + 1 positions. Where the
shift is 0, the exact suffix block selects a bucket of test strings, and
each is compared directly. The search runs in lanes over the buffer, all lanes
one step at a time with numpy; the steps of a lane are Wu-Manber's.

Spark splits the documents; the test strings are sent to the executors in
blocks of at most ``block_bytes`` of item text, and a larger benchmark takes
one pass for each block.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import materialize, unused, utf8_chunks, worker_state

SPACE, CUT = 32, 10  # between words; between documents
LANES = 16384
CLASS_BOUNDS = (0, 8, 16, 32, 64)  # lengths at which a new class of test strings begins
_HASH = np.uint64(0x9E3779B97F4A7C15)

_BYTES = np.full(256, SPACE, dtype=np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _BYTES[_c] = _c
for _c in range(ord("A"), ord("Z") + 1):
    _BYTES[_c] = _c + 32
_BYTES[128:] = np.arange(128, 256)


def item_windows(text: str | None, window: int) -> list[list[bytes]]:
    """Windows of an item's words: A-Z lower-cased, runs of digits, letters and non-ASCII."""
    words = _BYTES[np.frombuffer((text or "").encode(), dtype=np.uint8)].tobytes().split()
    if not words:
        return []
    return [words[i:i + window] for i in range(max(1, len(words) - window + 1))]


def normalise(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """All documents of a run as ``" \\n w1 w2 \\n w3 ... "``: single spaces
    around words, a CUT before each document."""
    n = len(offs) - 1
    out = np.insert(_BYTES[data], np.repeat(offs[:-1], 3), np.tile(np.array([SPACE, CUT, SPACE], np.uint8), n))
    out = np.append(out, np.array([SPACE, CUT, SPACE], np.uint8))
    space = out == SPACE
    space[1:] &= space[:-1].copy()
    space[0] = False
    return out[~space]


class _Class:
    """Shift table and suffix buckets for test strings of like lengths."""

    def __init__(self, strings: list[bytes]):
        self.m = m = min(map(len, strings))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(s[:m] for s in strings), dtype=np.uint8).reshape(len(strings), m)
        bits = min(24, max(12, math.ceil(math.log2(8 * len(strings) * (m - b + 1) + 1))))
        self.drop = np.uint64(64 - bits)
        far = min(255, m - b + 1)
        self.shift = np.full(1 << bits, far, dtype=np.uint8)
        padded = np.zeros((len(strings), 8), dtype=np.uint8)
        for at in range(m - b + 1):  # later blocks have smaller shifts and overwrite
            dist = m - b - at
            if dist < far:
                padded[:, :b] = heads[:, at:at + b]
                key = self.key(padded.view("<u8").ravel())
                self.shift[key] = np.minimum(self.shift[key], dist)
        buckets: dict[int, list[bytes]] = {}
        padded[:, :b] = heads[:, m - b:]
        for s, v in zip(strings, padded.view("<u8").ravel().tolist()):
            buckets.setdefault(v, []).append(s)
        self.suffixes = np.array(sorted(buckets), dtype=np.uint64)
        self.buckets = [buckets[v] for v in self.suffixes.tolist()]

    def key(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * _HASH) >> self.drop

    def search(self, buf: np.ndarray, raw: bytes, size: int):
        """``(position, test string)`` of every occurrence in ``buf[:size]``."""
        words = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        step = -(-size // LANES)
        pos = np.arange(0, size, step, dtype=np.int64)
        end = np.minimum(pos + step, size)
        tail = self.m - self.block
        while len(pos):
            block = words[pos + tail] & self.mask
            shift = self.shift[self.key(block)].astype(np.int64)
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                at = np.searchsorted(self.suffixes, block[zero])
                at[at == len(self.suffixes)] = 0
                same = self.suffixes[at] == block[zero]
                for p, k in zip(pos[zero[same]].tolist(), at[same].tolist()):
                    for s in self.buckets[k]:
                        if raw.startswith(s, p):
                            yield p, s
                shift[zero] = 1
            pos = pos + shift
            left = pos < end
            pos, end = pos[left], end[left]


class Matcher:
    """All test strings of a block of items ``(item id, text)``."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.owners: dict[bytes, tuple[int, set[str]]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                self.owners.setdefault(b" " + b" ".join(w) + b" ", (len(w), set()))[1].add(item)
        groups: dict[int, list[bytes]] = {}
        for s in self.owners:
            groups.setdefault(int(np.searchsorted(CLASS_BOUNDS, len(s), side="right")), []).append(s)
        self.classes = [_Class(g) for _, g in sorted(groups.items())]

    def run(self, data: np.ndarray, offs: np.ndarray):
        """Per document: number of words, disjoint hit word ranges, item ids."""
        n = len(offs) - 1
        norm = normalise(data, offs)
        size = len(norm)
        longest = max([c.m for c in self.classes], default=0)
        buf = np.concatenate([norm, np.zeros(longest + 16, np.uint8)])
        raw = norm.tobytes()
        start = (norm > SPACE)
        start[1:] &= norm[:-1] == SPACE
        count = np.cumsum(start, dtype=np.int64)
        cuts = np.flatnonzero(norm == CUT)
        base = count[cuts]  # words before each document, and all words
        words = np.diff(base)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for c in self.classes:
            for p, s in c.search(buf, raw, size):
                doc = int(np.searchsorted(cuts, p, side="right")) - 1
                length, owners = self.owners[s]
                first = int(count[p + 1]) - 1 - int(base[doc])
                ranges, items = found.setdefault(doc, ([], set()))
                ranges.append((first, first + length))
                items |= owners
        for doc in range(n):
            ranges, items = found.get(doc, ((), ()))
            yield int(words[doc]), _merged(sorted(ranges)), sorted(items)


def _merged(ranges) -> list[dict]:
    out: list[dict] = []
    for a, b in ranges:
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


_HITS = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                   ("items", pa.list_(pa.string()))])


def _search(text: Column, items, window: int) -> Column:
    """Hits of one block of items, a broadcast list, in a text column."""
    key = uuid.uuid4().hex

    @F.arrow_udf("n_words long, ranges array<struct<start: long, end: long>>, items array<string>")
    def hits(col: pa.Array) -> pa.Array:
        matcher, out = worker_state(key, lambda: Matcher(items.value, window)), []
        for data, offs in utf8_chunks(col):
            out += [{"n_words": n, "ranges": r, "items": i} for n, r, i in matcher.run(data, offs)]
        return pa.array(out, _HITS)
    return hits(text)


def _disjoint(ranges: Column) -> Column:
    """Ranges of several blocks as disjoint ranges, in order."""
    kind = "array<struct<start: bigint, end: bigint>>"

    def add(done, r):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        head = F.slice(done, 1, F.size(done) - 1)
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= r["start"]),
                      F.concat(head, F.array(grown))).otherwise(F.concat(done, F.array(r)))
    return F.aggregate(F.array_sort(ranges), F.expr(f"cast(array() as {kind})"), add)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20,
              out: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words``, ``ranges`` (disjoint
    hit word ranges, in order) and ``items`` (sorted ids, as strings, of the
    items with an occurring window)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"),
                             F.col(item_text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    names = []
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        name, = unused(docs, f"hits_{k}")
        docs = docs.withColumn(name, _search(F.col(text_col), sent, window))
        names.append(name)
        if blocks > 1:  # one block's tables in a worker at a time
            docs = materialize(docs, "hits")
    if blocks == 1:
        return docs.withColumnRenamed(names[0], out)
    merged = F.struct(F.col(names[0])["n_words"].alias("n_words"),
                      _disjoint(F.flatten(F.array(*(F.col(c)["ranges"] for c in names)))).alias("ranges"),
                      F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(c)["items"] for c in names))))).alias("items"))
    return docs.withColumn(out, merged).drop(*(c for c in names if c != out))


def n_hit(ranges: Column) -> Column:
    """Words in disjoint ranges."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, **names) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item."""
    out, = unused(docs, "hits")
    marked = with_hits(docs, benchmark, text_col, window=window, out=out, **names)
    return marked.where(F.size(F.col(out)["ranges"]) == 0).select(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 10, **names) -> DataFrame:
    """Contamination report, one row per input row.

    A document word inside any occurrence of a window is hit. Null and empty
    texts have no words and no hits; items without words have no window; equal
    windows of several items count for each of them; rows that repeat an item
    id are one item; a null item id is named ``null``. Repeated documents are
    reported each. Empty tables and extra columns on either side are fine.
    """
    marked = with_hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, window=window, **names)
    hits = n_hit(F.col("hits.ranges"))
    return marked.select(F.col("id").alias(id_col), F.col("hits.n_words").alias("n_words"), hits.alias("n_hit"),
                         F.size("hits.items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
                         (hits > 0).alias("contaminated"))


#: The report in DuckDB's SQL, with windows of 10 words.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
occ AS (
  SELECT rid, i, n, item
  FROM (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) JOIN win USING (n, g)),
hits AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM occ) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
