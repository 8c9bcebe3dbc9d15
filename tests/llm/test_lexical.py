import math
import re
from collections import Counter

import pytest
from blotter.llm import lexical
from blotter.llm.common import importable

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    texts = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in texts)
    n_terms = sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in texts:
            if not c:
                continue
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i, score))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


DOCS = [(1, "The cat sat on the mat. The END"), (2, "the cat"), (3, "The cat"), (4, None), (5, ""), (6, "... !!"), (7, "ÉCLAIR éclair x1 x1\x00x1"),
        (None, "the cat"), (2, "the cat"), (9, "dog " * 400 + "cat"), (10, "zebra"), (11, "cat dog zebra éclair Éclair")]
ITEMS = [("a", "The CAT, the dog"), ("b", None), ("c", "nothing here"), ("d", "éclair x1 zebra"), (None, "cat"), ("a", "mat end"), ("e", "...")]


@pytest.mark.parametrize("stages,block_bytes,block_items,k", [(1, 1 << 20, 256, 3), (3, 1 << 20, 2, 50), (4, 10, 1, 2), (7, 1 << 20, 256, 50)])
def test_equals_brute_force(spark, stages, block_bytes, block_items, k):
    importable(spark)
    docs = spark.createDataFrame([(*r, 0) for r in DOCS], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id string, text string, rank int")
    got = lexical.search(docs, items, k, stages=stages, block_bytes=block_bytes, block_items=block_items)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, ITEMS, k)


def test_long_texts_and_empty_tables(spark, monkeypatch):
    importable(spark)
    rows = [(1, "alpha beta " * 5000 + "gamma"), (2, "gamma"), (3, "beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, "gamma beta")], "item_id long, text string")
    assert sorted(map(tuple, lexical.search(docs, items).collect()), key=repr) == brute(rows, [(0, "gamma beta")], 50)
    assert lexical.search(docs.where("doc_id < 0"), items).count() == 0
    assert lexical.search(docs, items.where("item_id < 0")).count() == 0


def test_lengths_stay_exact_beyond_64_bits():
    import numpy as np
    w = lexical.Weights(10 ** 12, 3 * 10 ** 14, np.zeros(0), np.zeros(0))
    n = np.array([1, 300, 10 ** 9])
    assert w.lengths(n).tolist() == [50 + 50 * int(v) * 10 ** 12 // (3 * 10 ** 14) for v in n]
