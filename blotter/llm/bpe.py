"""BPE encoding and decoding with a transducer lexicon of frequent words.

A *word* here is what stands between white space: the tokeniser's pre-tokeniser
never joins across it, so a text's ids are the ids of its words in order.

Lexicon: Spark counts the words of all texts (combined in the tasks before the
shuffle); the most frequent ones, at most ``entries`` of at most ``MAX_WORD`` bytes, are
merged in tasks and compiled into a minimal acyclic automaton, in which words share
prefixes and suffixes. Arcs carry the number of words that sort before those behind
them, so the sum along a word's path is its rank, which names its ids in a pool. The
file (at most ``entries`` * ``MAX_WORD`` arcs) goes to each executor through Spark's
files and is memory-mapped there, one copy for all its workers. It only saves work: a
word that is not in it is merged exactly, by the ranks of the tokeniser's merges, so
the number of entries changes no result.

A batch's different words are looked up at once: one step of all of them along the
automaton is one binary search in the sorted (state, byte) keys.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm.common import materialize, text_runs, worker_state
from blotter.session import checkpoint_dir

ENTRIES, MAX_WORD = 500_000, 64
KEPT = 100_000  # pre-tokens of unseen words that a worker remembers, over which it starts anew
COUNTED = 400_000  # different words that a counting task holds before it hands them on
# characters outside of which str.lower and str.split do what the tokeniser's normaliser does
_ODD = re.compile("[\x1c-\x1fĀ-‏ -\U0010ffff]")


# pre-tokens of a word of such characters: contractions, letters, single numbers, other signs
_LETTERS, _NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the
    others in order from 256 on (the rule of byte-level vocabularies)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


_BYTES = _byte_alphabet()


class Words:
    """Splitting of texts into words as a ``tokenizers`` file would.

    The file must normalise by NFC, white space and case, pre-tokenise inside of
    white space, and have no decoder; other files raise ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        steps = [n["type"] for n in (conf["normalizer"] or {}).get("normalizers", [])]
        model = conf["model"]
        if (steps != ["NFC", "Replace", "Lowercase"] or conf["decoder"] or model["type"] != "BPE" or model["continuing_subword_prefix"]
                or model["byte_fallback"] or model["unk_token"] or model["dropout"]
                or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf["added_tokens"])):
            raise ValueError("a tokeniser of another kind")
        self.special = {f" {t['content']}": t["id"] for t in conf["added_tokens"]}  # words have no space
        self.marks = re.compile("(" + "|".join(re.escape(t[1:]) for t in self.special) + ")") if self.special else None
        self.model = model

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token's string is a word that begins with a space."""
        if self.marks and "<" in text and self.marks.search(text):
            parts = self.marks.split(text)
            return [w for i, p in enumerate(parts) for w in ([f" {p}"] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return text.lower().split()
        return [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]

    def pretokens(self, words: list[str]) -> Iterator[list[str]]:
        """Pre-tokens of each word, in the byte alphabet; special tokens have none."""
        odd = [w for w in words if _ODD.search(w)]
        starts = np.cumsum([0, *(len(w) + 1 for w in odd)])
        found = self.library.pre_tokenizer.pre_tokenize_str(" ".join(odd)) if odd else []
        cuts = iter(np.searchsorted([at[0] for _, at in found], starts).tolist() if found else [0] * len(starts))
        begin = next(cuts, 0)
        for w in words:
            if odd and _ODD.search(w):
                end = next(cuts)
                yield [t for t, _ in found[begin:end]]
                begin = end
            elif w[0] == " ":
                yield []
            elif w.isascii() and w.isprintable():
                yield [w] if w.isalpha() else _PARTS.findall(w)
            else:
                yield ["".join([_BYTES[c] for c in t.encode()]) for t in _PARTS.findall(w)]


class Merges:
    """Ids of words by the tokeniser's merges, exactly."""

    def __init__(self, words: Words):
        self.words, vocab = words, words.model["vocab"]
        self.vocab, self.end = vocab, words.model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {i: t[1:] for t, i in words.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(words.model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.known: dict[str, list[int]] = {}

    def pretoken(self, symbols: str) -> list[int]:
        """The least rank first, the leftmost of equal ones, until no pair merges."""
        last = len(symbols) - 1
        ids = [self.vocab[c + self.end if i == last else c] for i, c in enumerate(symbols)]
        after, before = [*range(1, last + 1), -1], [-1, *range(last)]
        ranks = self.ranks
        heap = [(*ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # one of the two has gone into another token
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (new, ids[k])) in ranks:
                    heapq.heappush(heap, (*ranks[p], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], new)) in ranks:
                heapq.heappush(heap, (*ranks[p], h, *p))
        return [i for i in ids if i >= 0]

    def encode(self, words: list[str]) -> list[list[int]]:
        if len(self.known) > KEPT:
            self.known = {}
        out, known = [], self.known
        for w, parts in zip(words, self.words.pretokens(words)):
            ids: list[int] = []
            for p in parts:
                if p not in known:
                    known[p] = self.pretoken(p)
                ids += known[p]
            out.append(ids if w not in self.words.special else [self.words.special[w]])
        return out


# ------------------------------------------------------------------ automaton

def compile_lexicon(words: list[bytes], outputs: list[bytes]) -> bytes:
    """The memory image of the minimal acyclic transducer of ``words`` (sorted,
    different, not empty) with their outputs.

    Words are added in order; when the next one leaves a path, the states behind the
    common prefix are complete and replaced by equal ones that are known (equal: same
    finality and the same arcs to the same states), so suffixes are shared.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each finished state: (final, (byte, target), ...)
    path: list[list] = [[False, []]]  # states of the last word's path: final, finished arcs
    last = b""

    def finish(depth: int) -> None:
        for at in range(len(path) - 1, depth, -1):
            final, done = path.pop()
            key = (final, *done)
            if key not in known:
                known[key] = len(arcs)
                arcs.append(key)
            path[-1][1].append((last[at - 1], known[key]))

    for word in words:
        if word <= last:
            raise ValueError("words must be sorted and different")
        n = 0
        while n < len(last) and n < len(word) and last[n] == word[n]:
            n += 1
        finish(n)
        path += [[False, []] for _ in word[n:]]
        path[-1][0], last = True, word
    finish(0)
    arcs.append((path[0][0], *path[0][1]))  # the root is the last state
    below = [0] * len(arcs)  # words behind a state; targets come first
    keys, targets, skips = [], [], []
    for state, (final, *out) in enumerate(arcs):
        count = int(final)
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(count)
            count += below[target]
        below[state] = count
    ends = np.cumsum([0, *map(len, outputs)])
    parts = [np.array(keys, "<i8").tobytes(), ends.astype("<i8").tobytes(), np.array(targets, "<i4").tobytes(),
             np.array(skips, "<i4").tobytes(), np.array([a[0] for a in arcs], "<i1").tobytes(), b"".join(outputs)]
    head = np.cumsum([8 * (len(parts) + 2), *map(len, parts)]).astype("<i8")
    return head.tobytes() + np.array([len(arcs)], "<i8").tobytes() + b"".join(parts)


class Lexicon:
    """A compiled lexicon, from a memory-mapped file or bytes."""

    def __init__(self, image):
        self.image = memoryview(image)
        cuts = np.frombuffer(self.image[:64], "<i8").tolist()
        part = [self.image[a:b] for a, b in zip(cuts, cuts[1:7])]
        self.keys, self.ends = (np.frombuffer(p, "<i8") for p in part[:2])
        self.targets, self.skips = (np.frombuffer(p, "<i4") for p in part[2:4])
        self.final, self.pool = np.frombuffer(part[4], "<i1"), part[5]
        self.root = cuts[7] - 1

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 if it is not in the lexicon."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes) - sizes
        at = np.flatnonzero((sizes > 0) & (sizes <= MAX_WORD))
        state, rank = np.full(len(at), self.root, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        step = 0
        while len(at):
            key = state << 8 | data[starts[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            at, arc, rank = at[on], arc[on], rank[on]
            state, rank, step = self.targets[arc].astype(np.int64), rank + self.skips[arc], step + 1
            ended = sizes[at] == step
            hit = ended & (self.final[state] == 1)
            out[at[hit]] = rank[hit]
            at, state, rank = at[~ended], state[~ended], rank[~ended]
        return out

    def outputs(self, ranks: np.ndarray) -> list[bytes]:
        """The outputs of the words of some ranks."""
        return [bytes(self.pool[a:b]) for a, b in zip(self.ends[ranks].tolist(), self.ends[ranks + 1].tolist())]


# ------------------------------------------------------------------ Spark

def _tokenizer(path: str | None) -> str:
    """The given file, or the public one where this process has it."""
    if path is None:
        import public_tokenizers
        return public_tokenizers.path("word_bpe_49k.json")
    return path


def word_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(word, n)`` over the whole texts of all rows; words of more than
    ``MAX_WORD`` bytes and special tokens are left out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(f"words {tokenizer}", lambda: Words(_tokenizer(tokenizer)))
        seen: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            rows = [(w, n) for w, n in seen.items() if len(w.encode()) <= MAX_WORD and not w.startswith(" ")]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for run in text_runs(batch.column(0)):
                for _, piece in run:
                    seen.update(words.split(piece.decode()))
                if len(seen) > COUNTED:
                    yield hand_on()
        yield hand_on()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, entries: int) -> DataFrame:
    """The words of a written table ``(word, n)`` down to the least frequency step (sixteenth
    of an octave) at which there are no more than ``entries``."""
    step = F.floor(F.log2("n") * F.lit(16)).cast("int")
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # 1,024 at most
    least, held = None, 0
    for r in steps:
        held += r["count"]
        if held > entries:
            break
        least = r.step
    return counts.where(step >= least if least is not None else F.lit(False)).select("word")


def build_lexicon(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, entries: int = ENTRIES) -> str:
    """Compile the most frequent words of all texts, at most ``entries``; returns the
    name under which Spark's files have the lexicon on each executor."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, text_col, tokenizer), "words")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_state(f"codec {tokenizer} None", lambda: Codec(tokenizer, None))
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.outputs([words])[0], pa.binary())], names=["word", "output"])

    rows = frequent_words(counts, entries).mapInArrow(merge, "word string, output binary").toArrow()  # bounded
    rows = sorted(zip((w.encode() for w in rows["word"].to_pylist()), rows["output"].to_pylist()))
    image = compile_lexicon([w for w, _ in rows], [o for _, o in rows])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    # not one of drop_scratch's paths: executors that start later fetch all files of a session
    path = f"{checkpoint_dir(spark).rstrip('/')}/lexicons/{name}"
    _write(spark, path, image)
    spark.sparkContext.addFile(path)
    return name


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in the shared folder, by whatever file system Spark has for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at:at + (1 << 22)]))
    finally:
        out.close()


class Codec:
    """A worker's encoder: the mapped lexicon, the merges, the words it met lately."""

    def __init__(self, tokenizer: str | None, lexicon: str | None):
        self.words = Words(_tokenizer(tokenizer))
        self.merges = Merges(self.words)
        self.lexicon = Lexicon.open(SparkFiles.get(lexicon)) if lexicon else Lexicon(compile_lexicon([], []))
        self.known: dict[str, bytes] = {}  # of the lexicon's words met: ids in decimals, a tab, tokens

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Outputs of words; those of the lexicon's words are kept."""
        new = list(words)
        ranks = self.lexicon.ranks([w.encode() for w in new])
        at = np.flatnonzero(ranks >= 0)
        out = dict(zip([new[i] for i in at.tolist()], self.lexicon.outputs(ranks[at])))
        self.known |= out
        unseen = [new[i] for i in np.flatnonzero(ranks < 0).tolist()]
        for w, ids in zip(unseen, self.merges.encode(unseen)):
            out[w] = f"{' '.join(map(str, ids))}\t{self.decode(ids)}".encode()
        return out

    def outputs(self, texts: list[list[str]]) -> list[list[bytes]]:
        """The output of each word of some texts; those not known yet are learnt together."""
        out = [[*map(self.known.get, ws)] for ws in texts]
        gaps = [(t, i) for t, found in enumerate(out) if None in found for i, o in enumerate(found) if o is None]
        if gaps:
            learnt = self.learn({texts[t][i] for t, i in gaps})
            for t, i in gaps:
                out[t][i] = learnt[texts[t][i]]
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as a tokeniser without a decoder has it; ids that are
        none of its own are left out."""
        tokens = self.merges.tokens
        return " ".join(tokens[i] for i in ids if i in tokens)


_OUT = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.large_string())])
_TYPE = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string, ids: array<int>, decoded: string>"


def encoded(text: Column, lexicon: str | None, tokenizer: str | None = None, with_ids: bool = True, with_text: bool = True) -> Column:
    """Struct of a text's encoding: number of ids, digests of the ids in decimals and of
    the decoded text, and, if asked, the ids and the decoded text."""
    @F.arrow_udf(_TYPE)
    def encode(col: pa.Array) -> pa.Array:
        codec = worker_state(f"codec {tokenizer} {lexicon}", lambda: Codec(tokenizer, lexicon))
        counts, ids, texts = [0] * len(col), [[] for _ in range(len(col))], [[] for _ in range(len(col))]
        digests = [(hashlib.sha256(), hashlib.sha256()) for _ in range(len(col))]
        for run in text_runs(col):
            split = [(row, codec.words.split(piece.decode())) for row, piece in run]
            for (row, _), found in zip(split, codec.outputs([ws for _, ws in split])):
                if found:
                    flat = b"\t".join(found).split(b"\t")
                    numbers, tokens = b" ".join(flat[::2]), b" ".join(flat[1::2])
                    for digest, part in zip(digests[row], (numbers, tokens)):
                        digest.update(b" " + part if counts[row] else part)
                    counts[row] += numbers.count(b" ") + 1
                    if with_ids:
                        ids[row].append(numbers)
                    if with_text:
                        texts[row].append(tokens)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array([a.hexdigest() for a, _ in digests]), pa.array([b.hexdigest() for _, b in digests]),
             pa.array([list(map(int, b" ".join(p).split())) if with_ids else None for p in ids], pa.list_(pa.int32())),
             pa.array([b" ".join(p).decode() if with_text else None for p in texts], pa.large_string())], fields=list(_OUT)).cast(
                 pa.struct([*list(_OUT)[:4], ("decoded", pa.string())]))
    return encode(text)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           entries: int = ENTRIES, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and
    ``ids`` and ``decoded`` (null unless asked).

    Ids equal the library's for the whole text, without added special tokens; a special
    token's string in a text is that token, as there. Null texts are empty; empty texts
    and such of white space have no ids and an empty decoded text. Very long texts are
    read in pieces that end at white space. Repeated rows and null ids have a row each.
    An empty table gives an empty result; other columns are ignored.
    """
    lexicon = build_lexicon(docs, text_col, tokenizer, entries)
    rows = docs.select(F.col(id_col).alias("id"), encoded(F.col(text_col), lexicon, tokenizer, with_ids, with_text).alias("e"))
    return rows.select(F.col("id").alias(id_col), "e.*")


def decoded(ids: Column, tokenizer: str | None = None) -> Column:
    """The text of an array of ids, special tokens included; null for null, null ids
    and ids the tokeniser does not have are left out."""
    @F.arrow_udf("string")
    def decode(col: pa.Array) -> pa.Array:
        codec = worker_state(f"codec {tokenizer} None", lambda: Codec(tokenizer, None))
        return pa.array([None if row is None else codec.decode([i for i in row if i is not None]) for row in col.to_pylist()], pa.string())
    return decode(ids)


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return encode(docs, with_ids=False, with_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
