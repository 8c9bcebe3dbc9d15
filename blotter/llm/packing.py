"""Best-fit sequence packing after Martello-Toth dominance reduction.

Documents are tokenised, longer ones cut into pieces of ``capacity`` tokens, and
the pieces are items of a bin-packing instance. What matters for packing is how
many pieces there are of each length, so the instance is a histogram of at most
``capacity`` rows, whatever the number of documents: Spark counts it, the driver
solves it, and Spark deals the plan out to the pieces.

Reduction (the Martello-Toth reduction procedure on lengths with counts): for
the longest free item, a set of at most three items that holds it and dominates
every other feasible set with it belongs to some optimal packing; it is fixed,
as many times as there are items for it, and the instance shrinks. The
remainder is packed best-fit decreasing, equal bins handled together.

The plan is a list of runs ``(length, first rank, count, first bin, offset)``:
the pieces of a length with ranks first .. first + count - 1 go to consecutive
bins, at the same offset. The number of runs is bounded by the lengths, not by
the pieces. A piece's rank among its length is found in two levels: pieces are
dealt to about the square root of the count many cells, cells are numbered by
their sums, so no window holds all pieces of a frequent length.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blotter.llm.common import materialize, utf8_chunks, worker_state

CACHE = 200_000  # words whose ids a worker keeps, in each of two generations
BATCH = 1 << 20  # bytes that are tokenised together
_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _SIGN, dtype=np.uint8)  # of a byte; 0 for space and line end
_KIND[[32, 10]] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_KIND[[*range(9), 9, *range(11, 32), 39, 127]] = _OTHER  # controls and the apostrophe
_KIND[128:0xC3] = _OTHER
_KIND[0xC4:] = _OTHER
_MIX = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """step ** i and its inverse modulo 2 ** 64, for i below n."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        row = np.full(n, base, dtype=np.uint64)
        row[:1] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class WordTokens:
    """Ids of a ``tokenizers`` file whose pre-tokeniser never joins characters
    across white space, word by word through a cache.

    Texts are split at spaces and line ends, words of plain letters, digits and
    signs also between these, as the pre-tokeniser would. Words are told apart by
    64-bit hashes that are computed for all words of a batch at once, each
    different word is encoded by the library, and ids are put together by words. Words
    used lately stay known (two generations, so that memory is bounded). A text
    that holds a special token's string is encoded whole; its words that hold
    one are neither encoded together with other texts' words nor kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special, self.cut = [x.encode() for x in special], special[0]
        self.cut_id = self.whole.token_to_id(self.cut)
        # the same model for words that are lower-case letters already: one pre-token each
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[int, bytes] = {}  # ids by hash, of this generation
        self.older: dict[int, bytes] = {}
        self.powers = _powers(BATCH + 1)

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *ends], ends)]

    def _encode_any(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.whole.encode(self.cut.join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = [*np.flatnonzero(ids == self.cut_id).tolist(), len(ids)]
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers[0]):
            self.powers = _powers(len(data) + 1)
        up, down = self.powers
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_MIX[data] * up[:len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[0]
        return h ^ (h >> np.uint64(29))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a run of UTF-8 bytes."""
        whole, n = data.tobytes(), len(data)
        padded = np.full(n + 2, 32, dtype=np.uint8)
        padded[1:-1] = data
        kind = _KIND[padded]  # of each byte, 0 white space
        # C3 and a second byte other than those of two signs is a letter that is composed already
        second = padded[:-1] == 0xC3
        kind[1:][second & (padded[1:] != 0x97) & (padded[1:] != 0xB7)] = _LETTER
        edge = np.zeros(n + 1, dtype=bool)  # a text ends its last word, whatever follows
        edge[offs] = True
        mine, before, after = kind[1:-1], kind[:-2], kind[2:]
        solid = mine > 0
        first, last = solid & ((before == 0) | edge[:-1]), solid & ((after == 0) | edge[1:])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        odd = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(mine == _OTHER, out=odd[1:])
        simple = odd[ends] == odd[starts]  # words of ASCII without apostrophes, and such letters
        plain = np.zeros(n + 1, dtype=np.int8)
        plain[starts[simple]] = 1
        plain[ends[simple]] -= 1
        plain = np.cumsum(plain[:-1], dtype=np.int8).view(bool)
        capital = _UPPER[data] | ((padded[:-2] == 0xC3) & (data >= 0x80) & (data <= 0x9E))
        small = data + (capital & plain) * np.uint8(32)
        # simple words fall into runs of letters, digits and signs, as the pre-tokeniser has it
        cut = np.flatnonzero(plain & (mine != before) & ~first)
        first[cut] = True
        last[cut - 1] = True
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        data = small
        codes, different = pd.factorize(self._hashes(data, starts, ends))
        seen = np.empty(len(different), dtype=np.int64)
        seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        letters = (odd[ends] == odd[starts]) & (mine[starts] == _LETTER) if len(starts) else np.zeros(0, bool)
        raw = data.tobytes()
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        cache, older, keys = self.cache, self.older, different.tolist()
        new: tuple[list[int], list[int]] = [], []
        whole_words = letters[seen].tolist()
        for i, k in enumerate(keys):
            if k not in cache:
                if k in older:
                    cache[k] = older[k]
                else:
                    new[whole_words[i]].append(i)
        marked = [mark for mark in self.special if mark in whole]
        for some, encode in zip(new, (self._encode_any, self._encode_plain)):
            words = [raw[x:y] for x, y in zip(starts[seen[some]].tolist(), ends[seen[some]].tolist())] if some else []
            if marked:  # their texts are encoded whole, below
                clear = [not any(mark in w for mark in marked) for w in words]
                some, words = [i for i, c in zip(some, clear) if c], [w for w, c in zip(words, clear) if c]
            if some:
                cache.update(zip([keys[i] for i in some], encode([w.decode() for w in words]), strict=True))
        known = [cache.get(k, b"") for k in keys] if marked else [cache[k] for k in keys]
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        begin = np.cumsum(sizes) - sizes
        size = sizes[codes]
        done = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin[codes] - done[:-1], size) + np.arange(done[-1])
        ids = pool[at].tobytes()
        cuts = done[np.searchsorted(starts, offs)].tolist()
        out = [ids[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]
        for mark in marked:
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                if mark in whole[a:b]:
                    out[i] = np.array(self.whole.encode(whole[a:b].decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def pieces_of(text: Column, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> Column:
    """Array of the pieces of a text: its ids, then ``end_id``, cut at capacity."""
    @F.arrow_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long, ids: binary>>")
    def cut(col: pa.Array) -> pa.Array:
        tokens = worker_state(f"tokens {tokenizer}", lambda: WordTokens(tokenizer))
        end, out = np.array([end_id], "<u4").tobytes(), []
        for data, offs in utf8_chunks(col, BATCH):
            for raw in tokens.encode(data, offs):
                raw += end
                cuts = range(0, len(raw), 4 * capacity)
                out.append([{"piece": i, "start": a // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part),
                             "ids": part if with_ids else None}
                            for i, a in enumerate(cuts) for part in (raw[a:a + 4 * capacity],)])
        return pa.array(out, pa.list_(_PIECE))
    return cut(text)


def reduce_and_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs ``(length, first rank, count, first bin, offset)`` and the number of bins."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    free = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(free)
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def place(n: int, count: int, first_bin: int, offset: int) -> None:
        runs.append((n, used[n], count, first_bin, offset))
        used[n] += count

    def take(n: int, count: int) -> None:
        free[n] -= count
        if not free[n]:
            del free[n]
            lengths.pop(bisect.bisect_left(lengths, n))

    def fix(group: list[int]) -> None:
        nonlocal bins
        need = {n: group.count(n) for n in group}
        times = min(free[n] // k for n, k in need.items())
        offset = 0
        for n in group:
            place(n, times, bins, offset)
            offset += n
        for n, k in need.items():
            take(n, times * k)
        bins += times

    def largest(room: int, n: int) -> int | None:
        """Longest free length up to room, beside one item of length n."""
        i = bisect.bisect_right(lengths, room) - 1
        if i >= 0 and lengths[i] == n and free[n] == 1:
            i -= 1
        return lengths[i] if i >= 0 else None

    def smallest(n: int, k: int) -> list[int]:
        out: list[int] = []
        for v in lengths:
            out += [v] * min(k - len(out), free[v] - (v == n))
            if len(out) == k:
                break
        return out

    at = capacity
    while lengths and lengths[0] <= at:
        n = lengths[bisect.bisect_right(lengths, at) - 1]
        room = capacity - n
        mate = largest(room, n)
        if mate is None:  # nothing fits beside it
            fix([n])
            continue
        low = smallest(n, 3)
        if mate == room or len(low) < 2 or low[0] + low[1] > room:  # an exact pair; or one mate at most, the longest
            fix([n, mate])
            continue
        if len(low) < 3 or sum(low) > room:  # two mates at most
            left, best = {**free, n: free[n] - 1}, None
            for a in reversed(lengths):
                if a > room or left[a] < 1:
                    continue
                if best and 2 * a <= sum(best):
                    break
                i = bisect.bisect_right(lengths, min(a, room - a)) - 1
                while i >= 0 and left[lengths[i]] < 1 + (lengths[i] == a):
                    i -= 1
                if i >= 0 and (best is None or a + lengths[i] > sum(best)):
                    best = (a, lengths[i])
            if best and mate >= sum(best):
                fix([n, mate])
                continue
            if best and mate == best[0]:
                above = []  # the two least lengths over the lesser mate's
                for v in lengths[bisect.bisect_right(lengths, best[1]):]:
                    above += [v] * min(2 - len(above), left[v])
                    if len(above) == 2:
                        break
                if len(above) < 2 or sum(above) > room:
                    fix([n, *best])
                    continue
        at = n - 1

    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first bin, number of bins)
    rooms: list[int] = []

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, count))

    for n in sorted(free, reverse=True):
        left = free[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                first, count = groups[room].pop()
                if not groups[room]:
                    rooms.pop(i)
            else:
                room, first, count = capacity, bins, -(-left // (capacity // n))
                bins += count
            each = min(room // n, left)
            full = min(count, left // each)
            for j in range(each):
                place(n, full, first, capacity - room + j * n)
            put(room - each * n, first, full)
            put(room, first + full, count - full)
            left -= each * full
    return runs, bins


def plan_table(runs, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs by length: first ranks (in order), first bins, offsets."""
    by: dict[int, list] = defaultdict(list)
    for n, rank, _, first, offset in runs:
        by[n].append((rank, first, offset))
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(r))) for n, r in by.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset`` (and ``ids``, little-endian 32-bit, if asked).

    Null and empty texts are one piece, the end id. Pieces of equal length are
    interchangeable; repeated rows are packed each. Sequences are gapless from
    offset 0 and never over ``capacity``. An empty table gives an empty result;
    columns other than the id's and text's are ignored.
    """
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    cut = pieces_of(F.col(text_col), tokenizer, capacity, end_id, with_ids)
    cols = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    # no text is without a piece, so outer gives the same rows; without it Spark first filters by the
    # array's size, which tokenises every text twice, in two Python workers per task
    pieces = materialize(docs.select(F.col(id_col).alias("id"), cut.alias("p"))
                         .select("id", F.explode_outer("p").alias("p")).select("id", "p.*").select(*cols), "pieces")
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most capacity rows
    runs, _ = reduce_and_fit(counts, capacity)
    plan = spark.sparkContext.broadcast(plan_table(runs, capacity))
    cells = F.element_at(F.array(*(F.lit(max(1, math.isqrt(counts.get(n, 1)))) for n in range(1, capacity + 1))), F.col("length").cast("int"))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), cells.cast("long")))
    # the order must not change if a lost task runs again: rows that tie in all columns are alike
    sums = dealt.groupBy("length", "cell").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(sums.select("length", "cell", before.alias("before")), "cells")
    place = F.row_number().over(W.partitionBy("length", "cell").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("place", place).join(sums, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("place") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        ranks = rank.to_numpy(np.int64)
        for n, at in length.groupby(length).indices.items():
            firsts, bins, offsets = plan.value[int(n)]
            i = np.searchsorted(firsts, ranks[at], side="right") - 1
            out[at, 0] = bins[i] + ranks[at] - firsts[i]
            out[at, 1] = offsets[i]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = ranked.withColumn("spot", spot("length", "rank"))
    return placed.select(F.col("id").alias(id_col), *cols[1:], "spot.sequence_id", "spot.offset")
