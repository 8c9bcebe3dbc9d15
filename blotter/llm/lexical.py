"""Ranked lexical search by pipelined term partitioning.

Documents are read once per block of items, in chunks (Arrow batches, so a chunk's
size is bounded), and become postings of the items' terms: a row per chunk and term,
with the places of the documents in the chunk and the term's occurrences. A term
belongs to one of ``stages`` owners. Items travel from owner to owner as bundles: the
bundle of an item and a chunk carries a sparse accumulator (places and integer scores)
and meets, in a cogroup by chunk, the postings of the stage's owner, which adds its
terms' contributions. After the last owner every chunk hands on each item's best
``k`` documents, and the best of these are the result, ranked by integers, ties by id.

Rare terms come first: owners get equal shares of the postings in the order of document
frequency, so that accumulators stay sparse until the last stages. No candidate is
pruned and no list capped before a chunk's exact selection. Memory of a group: items of
a block times documents of a chunk.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blotter.llm.common import materialize, text_runs

BLOCK_BYTES = 8 << 20  # of the items' texts whose terms are looked for together
BLOCK_ITEMS = 256  # items that are scored together
_TERM = np.arange(256, dtype=np.uint8)
_TERM[65:91] += 32
_TERM[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32
_TERM = _TERM.tobytes()


def terms(raw: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return raw.translate(_TERM).split()


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Lists of ``(id, different terms)`` of about ``block_bytes`` of text."""
    block, held = [], 0
    for r in items.select(id_col, text_col).toLocalIterator():
        raw = (r[1] or "").encode()
        block.append((r[0], sorted(set(terms(raw)))))
        held += len(raw)
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """A written table of ``(chunk, term, place, tf, ids)``.

    For each chunk a row of ``term`` -1 has the documents' ids and numbers of terms (in
    ``tf``), in the order of ids; places count from 0 in that order.
    """
    numbers = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first = numbers.value, TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            ids = batch.column(0)
            order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
            place = np.empty(len(ids), dtype=np.int64)
            place[order] = np.arange(len(ids))
            n, keys, tfs = np.zeros(len(ids), dtype=np.int64), [], []
            for run in text_runs(batch.column(1)):
                for row, piece in run:
                    words = terms(piece)
                    at = int(place[row])
                    n[at] += len(words)
                    found = Counter(filter(number.__contains__, words))
                    keys += [number[w] << 32 | at for w in found]
                    tfs += found.values()
            key, same = np.unique(np.array(keys, dtype=np.int64), return_inverse=True)
            tf = np.zeros(len(key), dtype=np.int64)
            np.add.at(tf, same, np.array(tfs, dtype=np.int64))  # the pieces of a long text
            term, cuts = np.unique(key >> 32, return_index=True)
            cuts = np.array([0, 0, *cuts[1:], len(key)] if len(key) else [0, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([first | k] * (len(term) + 1), pa.int64()), pa.array([-1, *term], pa.int32()),
                 _lists((key & 0xFFFFFFFF).astype(np.int32), cuts), _lists(np.concatenate([n, tf]), np.concatenate([[0], cuts[1:] + len(n)])),
                 pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * (len(term) + 1)], pa.int32()), ids.take(pa.array(order)))],  # in the first row
                names=["chunk", "term", "place", "tf", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    return materialize(rows.mapInArrow(read, "chunk long, term int, place array<int>, tf array<long>, ids array<long>"), "postings")


@dataclass
class Weights:
    """Corpus figures and the weight and owner of each term (-1: in no document)."""

    n_docs: int
    n_terms: int
    weight: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, posts: DataFrame, n_vocabulary: int, stages: int) -> Weights:
        each = posts.where("term = -1").agg(
            F.sum(F.size(F.filter("tf", lambda n: n > 0))).alias("docs"),
            F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, n: a + n)).alias("terms")).first()
        n_docs, n_terms = int(each.docs or 0), int(each.terms or 0)
        df = np.zeros(n_vocabulary, dtype=np.int64)
        for r in posts.where("term >= 0").groupBy("term").agg(F.sum(F.size("place")).alias("df")).collect():  # the block's terms
            df[r.term] = r.df
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(v) + 1))) if v else 0 for v in df]
        order = np.argsort(df, kind="stable")
        before = np.cumsum(df[order]) - df[order]
        owner = np.empty(n_vocabulary, dtype=np.int64)
        owner[order] = before * stages // max(1, int(df.sum()))
        owner[df == 0] = -1
        return cls(n_docs, n_terms, np.array(weight, dtype=np.int64), owner)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """Each document's m."""
        if 50 * int(n.max(initial=0)) * self.n_docs < 1 << 63:
            return 50 + 50 * n * self.n_docs // max(1, self.n_terms)
        return np.array([50 + 50 * int(v) * self.n_docs // self.n_terms for v in n], dtype=np.int64)


def _pass(bundles: DataFrame, owned: DataFrame, shared, last: int | None) -> DataFrame:
    """One owner's stage: bundles and its postings, met by chunk. ``last``: the number
    of documents that a chunk hands on for an item, at the final stage."""
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        weights, n_items, wanted = shared.value
        right = right.combine_chunks()
        term = right["term"].to_numpy()
        head = int(np.flatnonzero(term == -1)[0])
        n = weights.lengths(right["tf"][head].values.to_numpy())
        scores = np.zeros((n_items, len(n)), dtype=np.int64)
        for item, place, score in zip(left["item"].to_pylist(), left["place"], left["score"]):
            if item >= 0:
                scores[item, place.values.to_numpy()] = score.values.to_numpy()
        for row, t in enumerate(term.tolist()):
            items = wanted.get(t)
            if items is not None:
                place, tf = right["place"][row].values.to_numpy(), right["tf"][row].values.to_numpy()
                scores[items[:, None], place] += weights.weight[t] * (1_000_000_000 * tf // (1000 * tf + 20 * n[place]))
        chunk = right["owned_chunk"][head].as_py()
        items, values, places = [], [], []
        for item in np.flatnonzero(scores.any(axis=1)).tolist():
            place = np.flatnonzero(scores[item])
            score = scores[item, place]
            if last is not None:
                if len(score) > last:
                    some = score >= np.partition(score, len(score) - last)[len(score) - last]
                    place, score = place[some], score[some]
                best = np.lexsort((place, -score))[:last]
                place, score = place[best], score[best]
            items.append(item)
            places.append(place.astype(np.int32))
            values.append(score)
        cuts = np.cumsum([0, *map(len, places)])
        flat = np.concatenate([np.zeros(0, np.int32), *places])
        cols = [pa.array([chunk] * len(items), pa.int64()), pa.array(items, pa.int32()), _lists(flat, cuts),
                _lists(np.concatenate([np.zeros(0, np.int64), *values]), cuts)]
        names = ["chunk", "item", "place", "score"]
        if last is not None:
            ids = right["ids"][head].values
            cols[2], names[2] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), ids.take(pa.array(flat))), "ids"
        return pa.table(cols, names=names)

    schema = "chunk long, item int, place array<int>, score array<long>" if last is None else "chunk long, item int, ids array<long>, score array<long>"
    return bundles.groupBy("chunk").cogroup(owned.groupBy("owned_chunk")).applyInArrow(add, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", stages: int = 3, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item with a
    score above 0.

    A null text has no terms; such an item has no row, such a document isn't counted.
    Very long texts are read in pieces. Equal scores are ranked by ascending id, null
    ids first; rows of the same id are documents each, as are items. An empty table of
    either side gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"`{item_id}` {id_type}, rank int, `{doc_id}` long, score long")
    for block in item_blocks(items, item_id, item_text, block_bytes):
        vocabulary = sorted({t for _, ts in block for t in ts})
        number = {t: i for i, t in enumerate(vocabulary)}
        posts = postings(docs, vocabulary, doc_id, doc_text)
        weights = Weights.of(posts, len(vocabulary), stages)
        owners = pd.DataFrame({"term": [*range(len(vocabulary)), *[-1] * stages], "owner": [*weights.owner.tolist(), *range(stages)]})
        owners = spark.createDataFrame(owners, "term int, owner int")
        for at in range(0, len(block), block_items):
            some = block[at:at + block_items]
            wanted: dict[int, list[int]] = {}
            for i, (_, ts) in enumerate(some):
                for t in ts:
                    wanted.setdefault(number[t], []).append(i)
            shared = spark.sparkContext.broadcast((weights, len(some), {t: np.array(v) for t, v in wanted.items()}))
            bundles = posts.where("term = -1").select("chunk", F.lit(-1).alias("item"), F.array().cast("array<int>").alias("place"), F.array().cast("array<long>").alias("score"))
            for stage in range(stages):
                owned = posts.join(F.broadcast(owners.where(F.col("owner") == stage)), "term").drop("owner")  # a row per term of the block
                final = stage == stages - 1
                ids = F.when((F.col("term") == -1) & F.lit(final), F.col("ids"))  # one row per chunk, at the last stage
                owned = owned.select(F.col("chunk").alias("owned_chunk"), "term", "place", "tf", ids.alias("ids"))
                bundles = _pass(bundles, owned, shared, k if final else None)
            found = bundles.select("item", F.explode(F.arrays_zip("ids", "score")).alias("d")).select("item", F.col("d.ids").alias("id"), "d.score")
            best = W.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))
            ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(some)], f"item int, name {id_type}")
            out = out.union(ranked.join(F.broadcast(names), "item").select("name", "rank", "id", "score"))
    return out


_SPLIT = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')")

#: DuckDB SQL for the query's rows.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SPLIT}, []) AS ws FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
i AS (SELECT q, item_id, unnest(list_distinct(ws)) AS term
      FROM (SELECT row_number() OVER () AS q, item_id, coalesce({_SPLIT}, []) AS ws FROM benchmark) b),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) t
       WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) x, s),
m AS (SELECT r, doc_id, 50 + (50 * CAST(len(ws) AS BIGINT) * n_docs) // n_terms AS m FROM d, s WHERE len(ws) > 0),
p AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM o WHERE rank <= 50"""
