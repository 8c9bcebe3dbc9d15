import itertools
import math
import random
import re
import zlib
from collections import Counter

from blotter.llm import toxicity
from pyspark.sql import functions as F


def corpus(n, seed=1):
    """Prose with mild common words; toxic rows hold a few marked words, some by a marked stem only."""
    rnd = random.Random(seed)
    syl = ["an", "to", "re", "is", "en", "da", "lo", "mi", "ku", "ves"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(rnd.randint(30, 200))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(max(2, len(ws) // 30)):
                ws[rnd.randrange(len(ws))] = rnd.choice(["Idiot!", "zorgy", "zorgy" + word()])
        docs.append((i, " ".join(ws), "score", 1))
        labels.append((i, int(bad)))
    return docs, labels


SCHEMA = "doc_id long, text string, score string, id int"


def test_held_out_accuracy(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.toxicity(d, lab).collect()
    truth = dict(labels)
    assert len(rows) == 600
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
            for x in (labels, flipped))
    assert a == b


def test_edges(spark):
    docs, labels = corpus(60)
    odd = [(None, None, "x", 0), (None, "idiot", "x", 0), (3, docs[3][1], "x", 0), (900, "", "x", 0), (901, "12 ... !", "x", 0),
           (902, "idiot " * 50000, "x", 0)]
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs + odd, SCHEMA), lab)
    d = spark.createDataFrame(docs + odd, SCHEMA)
    rows = toxicity.toxicity(d, lab).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert not any(r.held_out for r in rows if r.doc_id is None)
    kept = toxicity.keep_ordinary(d, model)
    assert kept.columns == d.columns and kept.count() <= d.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(none, lab).collect() == []
    rows = toxicity.toxicity(spark.createDataFrame(corpus(5)[0], SCHEMA), lab).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)


def test_words_that_are_toxic_only_next_to_each_other(spark):
    """An expression of two ordinary words; the same words apart are in ordinary documents too."""
    rnd = random.Random(4)
    prose = ["of", "the", "and", "river", "stone", "garden", "window", "market", "walks", "under", "yellow", "seven"]
    docs, labels = [], []
    for i in range(900):
        ws = [rnd.choice(prose) for _ in range(rnd.randint(40, 80))]
        bad = i % 3 == 0
        for a, b in [("purple", "kettle")] * 3:
            at = rnd.randrange(1, len(ws) - 1)
            ws[at:at] = [a, b] if bad else [a, "over", b]
        docs.append((i, " ".join(ws), "x", 1))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), lab).collect() if r.held_out]
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) / len(held) > 0.95


def brute_statistics(texts, counted, min_docs, discount, mix, pad):
    """The model in plain Python: ``counted`` are (text, label), ``texts`` the whole corpus."""
    split = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower())
    vocabulary = {w for t in texts for w in split(t)}
    levels = [lambda u: "", *(lambda u, k=k: u[:k] for k in toxicity.PREFIXES), lambda u: u]
    count = {c: [Counter() for _ in levels] for c in (0, 1)}
    grams, after = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for t, c in counted:
        ws = split(t)
        for w in set(ws):
            for k, cut in enumerate(levels):
                count[c][k][cut(w + "$")] += 1
        for g in {g for n in (2, 3) for g in zip(*(ws[i:] for i in range(n)))}:
            grams[c][g] += 1
            after[c][g[:-1]] += 1
    kept = {g for g, n in grams[1].items() if n >= min_docs}
    types = [Counter(cut(w + "$") for w in vocabulary) for cut in levels]
    children = [{} for _ in levels]
    for k in range(1, len(levels)):
        for u in {*count[0][k], *count[1][k]}:
            children[k - 1].setdefault(levels[k - 1](u), set()).add(u)

    def word(w, c):
        u, p = w + "$", 1.0
        total = max(count[c][0][""], 1)
        for k in range(1, len(levels)):
            up, unit = levels[k - 1](u), levels[k](u)
            left = max(p - sum(max(count[c][k][x] - discount, 0) / total for x in children[k - 1].get(up, ())), 1e-12)
            if not count[0][k][unit] and not count[1][k][unit]:
                return left, True  # what both classes share below cancels
            p = max(count[c][k][unit] - discount, 0) / total + left * types[k][unit] / types[k - 1][up]
        return p, False

    def p(g, c):
        if len(g) == 1:
            return word(g[0], c)[0]
        h = g[:-1]
        mine = [x for x in kept if x[:-1] == h]
        if not mine:
            return p(g[1:], c)
        total = max(after[c][h], 1)
        left = max(1 - sum(max(grams[c][x] - discount, 0) / total for x in mine), 1e-12)
        return (max(grams[c][g] - discount, 0) / total if g in kept else 0) + left * p(g[1:], c)

    out = []
    for t in texts:
        ws = split(t)
        logs = [math.log(1 - mix + mix * p(g, 1) / p(g, 0)) for g in (tuple(ws[max(i - 2, 0):i + 1]) for i in range(len(ws)))]
        out.append(sum(logs) / max(len(ws) + pad, 1))
    return out


def test_statistics_against_brute_force(spark):
    rnd = random.Random(9)
    syl = ["an", "to", "res", "vé", "lo"]
    vocabulary = ["".join(s) for n in (1, 2, 3) for s in itertools.product(syl, repeat=n)]
    docs = [(i, " ".join(rnd.choice(vocabulary[:40] if rnd.random() < 0.7 else vocabulary) for _ in range(rnd.randint(0, 40))) + (" Vile to lo" if i % 4 == 0 else ""),
             "x", 1) for i in range(80)]
    labels = [(i, int(i % 4 == 0)) for i in range(60)]
    d = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"), min_docs=2)
    tune = {r.doc_id: r.t for r in d.select("doc_id", (F.pmod(F.hash("doc_id"), F.lit(4)) == 0).alias("t")).collect()}
    counted = [(docs[i][1], y) for i, y in labels if not tune[i]]
    want = brute_statistics([t for _, t, _, _ in docs], counted, 2, 0.75, model.mix, model.pad)
    scores = toxicity._Scores(model)
    got = scores.statistics([toxicity._words(t) for _, t, _, _ in docs])
    assert len(model.grams[0]) > 5 and any(g == g for g in model.grams[2])  # pairs, and pairs that triples go on from
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(got, want))


def test_at_most_max_labelled_rows_of_the_least_hashes(spark):
    docs, labels = corpus(200)
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = (toxicity.fit(d.repartition(n), lab.repartition(n), max_labelled=50) for n in (1, 7))
    assert all((x == y).all() for x, y in zip(a.words, b.words)) and a.limit == b.limit


def test_without_both_classes_nothing_is_toxic(spark):
    d = spark.createDataFrame(corpus(20)[0], SCHEMA)
    model = toxicity.fit(d, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.keep_ordinary(d, model).count() == 20


def test_wrong_labels_do_not_move_the_limit(spark):
    docs, labels = corpus(900, seed=3)
    rnd = random.Random(2)
    noisy = [(i, 1 - y if rnd.random() < 0.03 else y) for i, y in labels]
    rows = toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(noisy, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    toxic = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.9
