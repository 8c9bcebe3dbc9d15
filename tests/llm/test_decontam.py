import random

import brute
import pytest
from blotter.llm import decontam

DOCS = "doc_id long, text string, hits string, ID int"
ITEMS = "item_id long, text string, id string"


def check(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "y") for r in items], ITEMS)
    got = decontam.contamination(d, b, **kw).collect()
    want = [(i, *brute.contamination(t, items), ) for i, t in docs]
    want = [(*w, w[2] > 0) for w in want]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = decontam.decontaminate(d, b, **kw)
    assert kept.columns == d.columns
    assert sorted((r[0], r[1]) for r in kept.collect() if r[0] is not None) == sorted((w[0], t) for w, (_, t) in zip(want, docs) if not w[5] and w[0] is not None)


@pytest.mark.parametrize("blocks", [8 << 20, 300])
def test_against_brute_force(spark, blocks):
    rnd = random.Random(7)
    vocab = ["a", "be", "Über", "tion", "été", "x1", "THE", "of", "wholeheartedly", "ñ"]
    text = lambda n: rnd.choice([" ", "  ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 9, 10, 11, 25, 40]))) for i in range(30)]
    items += [(3, "one more row of item three"), (None, "an item without any id"), (50, None), (51, ""), (52, "..!"), (53, items[5][1])]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)]
    for i in range(60, 100):
        it = rnd.choice(items)[1] or ""
        docs.append((i, text(rnd.randint(0, 30)) + " " + it.upper() + rnd.choice([" ", ""]) + text(5)))
    docs += [(None, None), (7, ""), (7, "..."), (8, items[9][1]), (8, items[9][1]), (200, text(30000) + " " + (items[7][1] or ""))]
    check(spark, docs, items, block_bytes=blocks)


def test_windows_do_not_cross_documents(spark):
    check(spark, [(1, "one two three"), (2, "four five six"), (3, "three four")], [(1, "three four")])


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c"), (2, None)], [])
    check(spark, [], [])
