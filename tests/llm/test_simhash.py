import random

import brute
from blotter.llm import simhash


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, fp string, row_number int")


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(1, 7)))
    rows = []
    for i in range(40):
        ws = [word() for _ in range(rnd.choice([1, 2, 3, 30, 300]))]
        rows.append((len(rows), " ".join(ws)))
        for _ in range(rnd.randint(0, 3)):
            copy = list(ws)
            copy[rnd.randrange(len(copy))] = word()
            rows.append((1000 - len(rows), "\t".join(copy).upper()))
    return rows + [(5000, None), (4000, ""), (None, " \n"), (None, "only null ids"), (7, "Same Row é"), (7, "same row é"), (9000, "x y " * 20000)]


def test_against_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(rows_of(spark, rows)).collect()
    fps, comps, _ = brute.simhash_components(rows)
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comps)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_links_are_all_pairs_within_two_bits(spark):
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    fps = set(centres)
    for c in centres:
        for _ in range(30):
            x = c
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) % (1 << 64)).count("1") <= 2}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_long_chain_is_one_component(spark):
    chain = [(1 << i) - 1 for i in range(0, 63, 2)]
    got = simhash.components(spark.createDataFrame([(f,) for f in chain], "fp long")).collect()
    assert {r.root for r in got} == {0} and len(got) == len(chain)


def test_keep_one(spark, tmp_path):
    rows = corpus()
    rows_of(spark, rows).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    _, comps, groups = brute.simhash_components(rows)
    got = kept.collect()
    assert len(got) == len(set(groups))
    assert {r.doc_id for r in got} == set(comps)


def test_keep_one_when_a_second_read_packs_files_otherwise(spark, tmp_path, monkeypatch):
    rows = corpus()
    rows_of(spark, rows).repartition(12).write.parquet(str(tmp_path / "d"))
    _, comps, groups = brute.simhash_components(rows)
    size, write = "spark.sql.files.maxPartitionBytes", simhash.materialize
    before = spark.conf.get(size)

    def then_repack(df, name="table"):
        out = write(df, name)
        spark.conf.set(size, "8k")  # as if cores came or went after the first job
        return out
    monkeypatch.setattr(simhash, "materialize", then_repack)
    try:
        spark.conf.set(size, "1g")
        got = simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect()
    finally:
        spark.conf.set(size, before)
    assert len(got) == len(set(groups)) and {r.doc_id for r in got} == set(comps)


def plan_of_links(monkeypatch, run):
    """The plan that the first links of a run are written by."""
    plans, write = [], simhash.materialize

    def spy(df, name="table"):
        if name == "links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)
    monkeypatch.setattr(simhash, "materialize", spy)
    run()
    return plans[0]


def test_pipeline_does_not_broadcast_the_cells(spark, monkeypatch):
    from corpus_pipeline import drop_near_duplicates
    plan = plan_of_links(monkeypatch, lambda: drop_near_duplicates(spark, rows_of(spark, corpus()), "").collect())
    assert "SortMergeJoin [cell" in plan and "Broadcast" not in plan


def test_near_duplicates_do_not_broadcast_the_cells(spark, monkeypatch):
    plan = plan_of_links(monkeypatch, lambda: simhash.near_duplicates(rows_of(spark, corpus())).collect())
    assert "SortMergeJoin [cell" in plan and "Broadcast" not in plan


def test_empty_table(spark):
    assert simhash.near_duplicates(rows_of(spark, [])).collect() == []
    assert simhash.keep_one(rows_of(spark, [])).collect() == []
