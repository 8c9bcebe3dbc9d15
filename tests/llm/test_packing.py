import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from blotter.llm import packing
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length long, cell int"


def bins_of(counts, capacity):
    runs, bins = packing.reduce_and_fit(counts, capacity)
    used, ranks = {}, {}
    for n, rank, count, first, offset in runs:
        ranks.setdefault(n, []).extend(range(rank, rank + count))
        for b in range(first, first + count):
            used.setdefault(b, []).append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for items in used.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(used) == list(range(bins))
    return bins


def least_bins(items, capacity):
    """Exact optimum by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[i]}):
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_instances_near_the_optimum(items):
    counts = {n: items.count(n) for n in items}
    got, want = bins_of(counts, 20), least_bins(items, 20)
    assert want <= got <= want + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(7, 20), max_size=9))
def test_at_most_two_items_a_bin_is_optimal(items):
    counts = {n: items.count(n) for n in items}
    assert bins_of(counts, 20) == least_bins(items, 20)


def test_many_items():
    rnd = random.Random(1)
    counts = {n: rnd.randint(0, 10**9) for n in range(1, 2049)}
    runs, bins = packing.reduce_and_fit(counts, 2048)
    low = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert bins <= low * 1.01 and len(runs) < 100_000


def texts():
    rnd = random.Random(5)
    odd = ["Don't", "it's", "été,", "É", "naïve!!", "a<|endoftext|>b", "x y", "ẞ", "é", "Ⅷ", "12ab34", "...", "a|b", "İstanbul",
           "日本語", "ΣΑΣ", "😀👍", "\tTab\r\nnew", "ǅ", "ﬁn", "--", "can't.", "'tis", "​", "K"]
    out = [None, "", " ", "\n \n", *odd]
    for _ in range(80):
        out.append(rnd.choice([" ", "\n", "  "]).join(rnd.choice([*odd, "the", "thatoneshere", "Réeux.", "word,", "WORD!!"]) for _ in range(rnd.randint(1, 400))))
    return [*out, "long " * 30000, out[40], out[40]]


def test_word_tokens_equal_the_library():
    whole = Tokenizer.from_file(PATH)
    data = [t or "" for t in texts()]
    raw = [t.encode() for t in data]
    tokens = packing.WordTokens(PATH)
    run = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    assert tokens.encode(*run) == tokens.encode(*run)
    for t, got in zip(data, tokens.encode(*run)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_special_tokens_in_odd_words_leave_other_texts_alone():
    whole = Tokenizer.from_file(PATH)
    tokens = packing.WordTokens(PATH)
    for mark in ("<|startoftext|>", "<|endoftext|>"):
        for form in (f"'{mark}'", f"a\t{mark}\tb", f"\t{mark}{mark}'", f"日{mark}本", mark):
            data = [f"first can't {form} isn't", "日本 won't été 'tis", "tab\tglued it's wasn't ΣΑΣ"]
            raw = [t.encode() for t in data]
            run = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
            for fresh in (packing.WordTokens(PATH), tokens):  # also with the words of earlier calls
                for t, got in zip(data, fresh.encode(*run)):
                    assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, (form, t)


@pytest.mark.parametrize("capacity", [2048, 37])
def test_pack(spark, capacity):
    whole = Tokenizer.from_file(PATH)
    data = texts()
    d = spark.createDataFrame([(i if i % 7 else None, t, 5, 1) for i, t in enumerate(data)], SCHEMA)
    rows = packing.pack(d, capacity=capacity, with_ids=True).collect()
    want = []
    for i, t in enumerate(data):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            raw = np.array(ids[a:a + capacity], "<u4").tobytes()
            want.append((i if i % 7 else None, k, a, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows), key=repr) == sorted(want, key=repr)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in seqs.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(seqs) <= -(-sum(r.length for r in rows) // capacity) * 1.1 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_are_tokenised_once(spark, monkeypatch):
    plans, write = {}, packing.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(packing, "materialize", seen)
    d = spark.createDataFrame([(1, "one text", 5, 1), (2, None, 5, 1), (None, "", 5, 1)], SCHEMA)
    rows = packing.pack(d).collect()
    assert plans["pieces"].count("ArrowEvalPython") == 1
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 1), (1, 0, 3), (2, 0, 1)]
