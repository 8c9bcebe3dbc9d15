import hashlib

import pytest
from blotter.llm import bpe
from blotter.llm.common import importable

SF = "/root/testdata/sf0.001"
PATH = bpe._tokenizer(None)

TEXTS = [
    None, "", " \n\t ", "Hello, WORLD it's they'll 12 x1’s ... (a)b", "naïve Ñandú ÉÀ ß", "é Å ẛ̣", "ΑΣ ΣΑΣ. ὈΔΥΣΣΕΎΣ",
    "İstanbul DŽ ﬁ ŉ K Å", "a\x1cb \x1d c\x00d \x7f\x85x\xa0y z w　v", "日本語のテキスト 한국어 अनुच्छेद العربية",
    "👩‍👩‍👧 ½ ² ① ٣", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c '<|endoftext|>'", "<|ENDOFTEXT|> <|endoftext <|endoftext|", "x" * 3000,
    "don't 's 't're'll''d 'S", "Hello, WORLD it's they'll 12 x1’s ... (a)b", "á́ ́b \ń", "“quoted” – dash — …",
]


LIBRARY = bpe.Words(PATH).library


def want(text):
    library = LIBRARY
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_words_and_merges_equal_the_library():
    words = bpe.Words(PATH)
    merges = bpe.Merges(words)
    for t in TEXTS:
        ids = [i for part in merges.encode(words.split(t or "")) for i in part]
        assert ids == want(t)[0], t


def test_every_low_character_splits_as_in_the_library():
    words = bpe.Words(PATH)
    merges = bpe.Merges(words)
    for c in [*range(0x250), *range(0x2000, 0x2070), 0xfeff, 0x1f600]:
        t = f"aB{chr(c)}C d{chr(c)} {chr(c)}"
        assert [i for part in merges.encode(words.split(t)) for i in part] == words.library.encode(t, add_special_tokens=False).ids, hex(c)


def test_automaton_is_minimal_and_exact():
    words = sorted({w.encode() for w in ("tap taps top tops tapping topping stop stops a ab abc ñu ñus".split())})
    outputs = [w.upper() * i for i, w in enumerate(words)]
    lex = bpe.Lexicon(bpe.compile_lexicon(words, outputs))
    asked = [*words, b"ta", b"", b"tapss", b"zz", b"st", b"x" * 100]
    ranks = lex.ranks(asked)
    assert ranks.tolist() == [*range(len(words)), *[-1] * 6]
    assert lex.outputs(ranks[:len(words)]) == outputs
    # minimal: as many states as there are different sets of endings
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert lex.root + 1 == len(endings)
    assert bpe.Lexicon(bpe.compile_lexicon([], [])).ranks([b"a", b""]).tolist() == [-1, -1]


def test_frequent_words_are_whole_steps(spark):
    rows = [("a", 1000), ("b", 999), ("c", 100), ("d", 10), ("e", 10), ("f", 1)]
    counts = spark.createDataFrame(rows, "word string, n long")
    for entries, want in ((0, ""), (1, ""), (2, "ab"), (4, "abc"), (5, "abcde"), (100, "abcdef")):
        assert sorted(r.word for r in bpe.frequent_words(counts, entries).collect()) == sorted(want)


@pytest.mark.parametrize("entries", [0, 3, 200_000])
def test_edges_whatever_the_lexicon(spark, entries):
    importable(spark)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (3, TEXTS[3], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, entries=entries).collect()
    assert len(got) == len(rows)
    texts = dict(enumerate(TEXTS)) | {None: "a b"}
    for r in got:
        ids, text = want(texts[r.doc_id])
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids))
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(text))
    assert bpe.encode(docs.where("doc_id < 0"), entries=entries).count() == 0
    back = bpe.encode(docs, entries=entries).select("decoded", bpe.decoded("ids").alias("again")).collect()
    assert all(r.decoded == r.again for r in back)


def test_query_equals_the_library(spark):
    importable(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.digests(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, text = want(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_long_texts_are_cut_at_white_space(monkeypatch):
    import pyarrow as pa
    from blotter.llm.common import text_runs
    texts = ["aa bb\ncc " * 40, None, "x" * 500, "", "é " * 100]
    runs = list(text_runs(pa.array(texts), 50))
    for i, t in enumerate(texts):
        pieces = [p for run in runs for row, p in run if row == i]
        assert b"".join(pieces).decode() == (t or "")
        assert all(p[-1:] in b" \n" for p in pieces[:-1])
