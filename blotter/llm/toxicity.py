"""Toxicity scores from class-conditional Kneser-Ney models.

The units are expressions of one to three words (words are lower-cased runs of
letters); rare words back off to their prefixes of 7, 5, 4 and 3 characters. For
class c, with discount D,

    P_c(w | h) = max(n_c(h w) - D, 0) / n_c(h) + rest_c(h) * P_c(w | h')

where h is the one or two words before w, h' drops the first of them, n_c counts the
class's documents that hold an expression (so no long document rules the model),
n_c(h) sums those of all expressions that go on from h, and rest_c(h) is the mass
that the discounted counts leave. Words without h go down the prefixes alike,

    P_c(u) = max(n_c(u) - D, 0) / N_c + rest_c(parent) * types(u) / types(parent)

and types(u), the continuation count, is the number of different words of the *whole*
corpus, labelled or not, that begin with u: both classes smooth rare words
through the same shared counts. Toxic documents hold some toxic expressions among
ordinary ones, so their likelihood is that of the mixture (1 - ``mix``) P_ordinary +
``mix`` P_toxic. A document's statistic is its log-likelihood ratio, toxic to
ordinary, per word (of its words and ``pad`` neutral ones). On labelled rows that
were not counted, the limit is where the classes' error rates have the least sum, so
some wrong labels don't move it, and a logistic curve around it gives the score.

Size: class counts come from at most ``max_labelled`` labelled rows. The model has
every word and prefix that these hold and every longer expression that
``min_docs`` of their toxic documents hold; nothing else is left out. It is worked out
by Spark, level by level, and goes to the executors as sorted 64-bit keys with
ratios, 16 bytes each. Shared counts cover all documents. (Keys are XXH64: among ten
million, two meet with a probability of 3e-6.)
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import materialize, unused, worker_state

PREFIXES = (3, 4, 5, 7)
END = "$"  # after a whole word
FLUSH = 200_000  # words that a task counts before it hands them on
CACHE = 200_000  # words whose scores a worker keeps

#: ASCII bytes but letters separate words; bytes of other characters stay.
_LETTERS = bytes(c if chr(c).isascii() and chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def _words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def word_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """``(word, toxic, ordinary)`` of all documents; unlabelled ones add words
    with zero counts."""
    def count(batches):
        counts = {1: Counter(), 0: Counter(), None: Counter()}

        def rows():
            every = list(set().union(*counts.values()))
            cols = [pa.array([w.decode() for w in every]), *(pa.array([counts[c][w] for w in every], pa.int64()) for c in (1, 0))]
            for c in counts.values():
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "toxic", "ordinary"])

        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1).to_pylist()):
                if t.is_valid:
                    counts[c].update(set(_words(t.as_py())))
                    if sum(map(len, counts.values())) > FLUSH:
                        yield rows()
        yield rows()
    seen = docs.select(text, label).mapInArrow(count, "word string, toxic long, ordinary long")
    return seen.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def nodes(counts: DataFrame) -> DataFrame:
    """``(level, unit, parent, toxic, ordinary, types)``: the words (the last
    level) and their prefixes, each level summed from the one below it."""
    unit = F.concat(F.col("word"), F.lit(END))
    out, level = None, counts.select(unit.alias("unit"), "toxic", "ordinary", F.lit(1).cast("long").alias("types"))
    for k in range(len(PREFIXES), -1, -1):
        parent = F.substring("unit", 1, PREFIXES[k - 1]) if k else F.lit("")
        level = level.withColumn("parent", parent).withColumn("level", F.lit(k))
        part = level.select("level", "unit", "parent", "toxic", "ordinary", "types")
        out = part if out is None else out.union(part)
        level = level.groupBy(F.col("parent").alias("unit")).agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary", "types")))
    return out


def ratios(tree: DataFrame, totals: tuple[int, int, int], discount: float) -> DataFrame:
    """``(level, key, toxic, ordinary, rest)`` of the units that a class holds: their
    probabilities, and the ratio, toxic to ordinary, of what is below them and unseen.

    Goes down from the root, a join per level. A unit that no class holds has the
    ratio of its parent's rest."""
    spark, n = tree.sparkSession, [float(max(t, 1)) for t in totals]
    seen = materialize(tree.where("toxic > 0 or ordinary > 0"), "seen")
    up = spark.range(1).select(F.lit("").alias("up"), F.lit(1.0).alias("up_t"), F.lit(1.0).alias("up_o"), F.lit(n[2]).alias("up_types"))
    out = None
    for level in range(len(PREFIXES) + 1):
        at = seen.where(F.col("level") == level).select(
            "unit", "parent", "types", *(F.greatest(F.col(c) - discount, F.lit(0.0)).alias(c) for c in ("toxic", "ordinary")))
        claimed = at.groupBy(F.col("parent").alias("up")).agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary")))
        mass = lambda p, c, i: F.greatest(F.col(p) - F.coalesce(F.col(c), F.lit(0.0)) / n[i], F.lit(1e-12))
        left = materialize(up.join(claimed, "up", "left").select(
            "up", "up_t", "up_o", "up_types", mass("up_t", "toxic", 0).alias("left_t"), mass("up_o", "ordinary", 1).alias("left_o")), "left")
        part = left.select(F.lit(level).alias("level"), F.xxhash64("up").alias("key"), F.col("up_t").alias("toxic"), F.col("up_o").alias("ordinary"),
                           (F.col("left_t") / F.col("left_o")).alias("rest"))
        out = part if out is None else out.union(part)
        share = F.col("types") / F.col("up_types")
        up = at.join(left, F.col("parent") == F.col("up")).select(
            F.col("unit").alias("up"), (F.col("toxic") / n[0] + F.col("left_t") * share).alias("up_t"),
            (F.col("ordinary") / n[1] + F.col("left_o") * share).alias("up_o"), F.col("types").cast("double").alias("up_types"))
    words = up.select(F.lit(len(PREFIXES) + 1).alias("level"), F.xxhash64("up").alias("key"), F.col("up_t").alias("toxic"),
                      F.col("up_o").alias("ordinary"), F.lit(None).cast("double").alias("rest"))
    return materialize(out.union(words), "ratios")


_NEXT = np.uint64(0x9E3779B97F4A7C15)  # key of an expression: key of its history times this, plus its last word's


def _key(unit: bytes) -> int:
    """As Spark's ``xxhash64`` of the string, unsigned."""
    return xxhash.xxh64_intdigest(unit, 42)


def _prefix(unit: bytes, n: int) -> bytes:
    """The first n characters."""
    return unit[:n] if unit.isascii() else unit.decode()[:n].encode()


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _expressions(text: str) -> np.ndarray:
    """Different expressions of two and three words: rows of key, history's key, key without the first word."""
    end = END.encode()
    h = np.array([_key(w + end) for w in _words(text)], dtype=np.uint64)
    two = h[:-1] * _NEXT + h[1:]
    three = two[:-1] * _NEXT + h[2:]
    rows = np.concatenate([np.stack([two, h[:-1], h[1:]], 1), np.stack([three, two[:-1], two[1:]], 1)])
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def expressions(counted: DataFrame, text: str, label: str, min_docs: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Expressions that ``min_docs`` toxic documents hold, ``(key, history, lower, toxic, ordinary)``
    in the order of keys, and their histories, ``(key, toxic, ordinary)``."""
    def toxic_ones(batches):
        for batch in batches:
            rows = [_expressions(t.as_py()) for t in batch.column(0) if t.is_valid]
            if rows:
                cols = np.concatenate(rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[:, i])) for i in range(3)], ["key", "history", "lower"])

    schema = "key long, history long, lower long"
    often = counted.where(F.col(label) == 1).select(text).mapInArrow(toxic_ones, schema).groupBy("key").agg(
        F.count("*").alias("n"), F.min("history").alias("history"), F.min("lower").alias("lower")).where(F.col("n") >= min_docs)
    kept = often.select("key", "history", "lower").toArrow().to_pandas().astype("int64").to_numpy().view(np.uint64)
    kept = kept[np.argsort(kept[:, 0])]
    histories = np.unique(kept[:, 1])
    sent = counted.sparkSession.sparkContext.broadcast((kept[:, 0].copy(), histories))

    def both(batches):
        tables = sent.value
        counts = [np.zeros((2, len(k)), dtype=np.int64) for k in tables]
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1).to_pylist()):
                if t.is_valid:
                    rows = _expressions(t.as_py())
                    for col, (keys, n) in enumerate(zip(tables, counts)):
                        at = _find(keys, rows[:, col])
                        np.add.at(n[c], at[at >= 0], 1)
        for kind, n in enumerate(counts):
            at = np.flatnonzero(n.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])],
                                             ["kind", "at", "toxic", "ordinary"])

    sums = (counted.select(text, label).mapInArrow(both, "kind int, at long, toxic long, ordinary long")
            .groupBy("kind", "at").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow().to_pandas())
    out = []
    for kind, table in enumerate((pd.DataFrame(kept, columns=["key", "history", "lower"]), pd.DataFrame({"key": histories}))):
        mine = sums[sums["kind"] == kind].set_index("at").reindex(range(len(table)), fill_value=0)
        out.append(table.assign(toxic=mine["toxic"].to_numpy(float), ordinary=mine["ordinary"].to_numpy(float)))
    return out[0], out[1]


@dataclass
class Model:
    """Ratios of probabilities, toxic to ordinary, by sorted keys."""

    words: tuple[np.ndarray, np.ndarray]  # keys, ratios
    rest: tuple[np.ndarray, np.ndarray]  # of what is unseen below a prefix
    root: float  # of what is unseen below none
    after: tuple[np.ndarray, np.ndarray]  # words that expressions go on from: factor of other words behind them
    grams: tuple[np.ndarray, np.ndarray, np.ndarray]  # expressions: keys, ratios, factor of other words behind them (or NaN)
    mix: float
    pad: float
    slope: float = 1.0
    limit: float = 1.0

    def word_ratios(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys and ratios of words."""
        end = END.encode()
        units = [w + end for w in words]
        keys = np.fromiter(map(_key, units), dtype=np.uint64, count=len(units))
        at = _find(self.words[0], keys)
        out = np.where(at >= 0, self.words[1][at] if len(self.words[0]) else 1.0, np.nan)
        for k in reversed(PREFIXES):
            open_ = np.flatnonzero(np.isnan(out)).tolist()  # (a shorter unit is a prefix of itself and not in the table)
            if open_:
                at = _find(self.rest[0], np.array([_key(_prefix(units[i], k)) for i in open_], dtype=np.uint64))
                out[open_] = np.where(at >= 0, self.rest[1][at] if len(self.rest[0]) else 1.0, np.nan)
        return keys, np.where(np.isnan(out), self.root, out)


def _with_expressions(grams: pd.DataFrame, histories: pd.DataFrame, words: pd.DataFrame, discount: float) -> tuple[tuple, tuple]:
    """Ratios of expressions and factors of their histories (``Model.grams``, ``Model.after``)."""
    at = _find(histories["key"].to_numpy(np.uint64), grams["history"].to_numpy(np.uint64))
    p, rest = [], []
    low_word = _find(words["key"].to_numpy(np.uint64), grams["lower"].to_numpy(np.uint64))
    low_gram = _find(grams["key"].to_numpy(np.uint64), grams["lower"].to_numpy(np.uint64))
    for c in ("toxic", "ordinary"):
        total = histories[c].to_numpy()
        own = np.maximum(grams[c].to_numpy() - discount, 0) / np.maximum(total[at], 1)
        left = np.maximum(1 - np.bincount(at, own, minlength=len(histories)), 1e-12)
        base = words[c].to_numpy()[low_word]
        pair = own + left[at] * base
        p.append(np.where(low_word >= 0, pair, own + left[at] * pair[low_gram]))  # what a triple backs off to is a pair here
        rest.append(left)
    factor = rest[0] / rest[1] if len(histories) else np.zeros(0)
    keys = histories["key"].to_numpy(np.uint64)
    back = _find(keys, grams["key"].to_numpy(np.uint64))
    behind = np.where(back >= 0, factor[back], np.nan) if len(keys) else np.zeros(0)
    return (keys, factor), (grams["key"].to_numpy(np.uint64), p[0] / p[1] if len(grams) else np.zeros(0), behind)


class _Scores:
    """Statistics of texts; keys and ratios of the words met lately are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.keys, self.ratio, self.after = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def look_up(self, words: set[bytes]) -> None:
        new = list(words.difference(self.slots))
        if not new:
            return
        if len(self.slots) + len(new) > CACHE:
            self.clear()
            new = list(words)
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
        keys, ratio = self.model.word_ratios(new)
        at = _find(self.model.after[0], keys)
        after = np.where(at >= 0, self.model.after[1][at], np.nan) if len(self.model.after[0]) else np.full(len(new), np.nan)
        self.keys, self.ratio, self.after = (np.concatenate(x) for x in ((self.keys, keys), (self.ratio, ratio), (self.after, after)))

    def statistics(self, texts: list[list[bytes]]) -> np.ndarray:
        model, size = self.model, np.array([len(t) for t in texts], dtype=np.int64)
        self.look_up(set().union(*texts))
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(size.sum()))
        owner, r, h = np.repeat(np.arange(len(texts)), size), self.ratio[slots].copy(), self.keys[slots]
        if len(model.grams[0]) and len(slots) > 1:
            keys, ratio, behind = model.grams
            key, found = np.zeros(len(slots), np.uint64), np.full(len(slots), -1)
            key[1:] = h[:-1] * _NEXT + h[1:]
            known = np.concatenate([[False], ~np.isnan(self.after[slots[:-1]]) & (owner[1:] == owner[:-1])])
            at = np.flatnonzero(known)
            found[at] = _find(keys, key[at])
            r[at] = np.where(found[at] >= 0, ratio[found[at]], self.after[slots[at - 1]] * r[at])
            goes_on = np.concatenate([[False], (found[:-1] >= 0) & ~np.isnan(behind[found[:-1]]) & (owner[1:] == owner[:-1])])
            at = np.flatnonzero(goes_on)
            three = _find(keys, key[at - 1] * _NEXT + h[at])
            r[at] = np.where(three >= 0, ratio[three], behind[found[at - 1]] * r[at])
        logs = np.log1p(model.mix * (r - 1))
        return np.bincount(owner, logs, minlength=len(texts)) / np.maximum(size + model.pad, 1)


def _statistic(text: Column, sent) -> Column:
    key = uuid.uuid4().hex

    @F.arrow_udf("double")
    def statistic(col: pa.Array) -> pa.Array:
        scores, out, run, held = worker_state(key, lambda: _Scores(sent.value)), [], [], 0
        for t in pc.fill_null(col, ""):
            run.append(_words(t.as_py()))
            held += len(run[-1])
            if held > FLUSH:
                out.append(scores.statistics(run))
                run, held = [], 0
        if run:
            out.append(scores.statistics(run))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
    return statistic(text)


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and limit of a logistic curve: the limit halves the gap at which the sum of both
    classes' error rates is least (the lowest of such), the slope is fitted with both classes
    weighing alike."""
    if not len(x) or y.min() == y.max():
        return 1.0, 1.0
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    pos, neg = y.sum(), (1 - y).sum()
    gain = (pos - np.concatenate([[0], np.cumsum(y)])) / pos + np.concatenate([[0], np.cumsum(1 - y)]) / neg
    gain[1:-1][x[1:] == x[:-1]] = -1
    i = int(np.argmax(gain))
    limit = float((x[i - 1] + x[i]) / 2) if 0 < i < len(x) else float(x[0] if i == 0 else x[-1] + 1e-9)
    scale = max(float(np.abs(x - limit).mean()), 1e-9)
    z, weight, w = (x - limit) / scale, np.where(y == 1, 1 / pos, 1 / neg), 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w * z, -30, 30)))
        step = ((weight * (p - y)) @ z + ridge * w) / ((weight * p * (1 - p)) @ z ** 2 + ridge)
        w = min(max(w - np.clip(step, -1, 1), 0.1), 50.0)
        if abs(step) < 1e-8:
            break
    return float(w / scale), limit


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = 50_000, min_docs: int = 5, discount: float = 0.75, mix: float = 0.005, pad: float = 10.0) -> Model:
    """Learn a model from ``labels`` (all its rows may be learned from).

    Of the labelled ids at most ``max_labelled`` are taken, those of the least
    hashes; a fourth of them, by another hash, only fits the logistic curve. Rows of
    ``labels`` with a null id or label are left out; of several labels of an id
    the largest holds. Without rows of both classes the curve is not fitted and
    ordinary texts score below 0.5.
    """
    spark = docs.sparkSession
    rows = (labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
            .where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))
    # the least hashes of about as many ids as are wanted, then exactly those
    share = min(1.0, 1.2 * max_labelled / max(rows.count(), 1))
    rows = rows.withColumn("h", F.xxhash64("id")).where(F.shiftrightunsigned("h", 34) <= int(share * (1 << 30)))
    rows = materialize(rows.orderBy(F.shiftrightunsigned("h", 34), "h", "id").limit(max_labelled)
                       .select("id", "label", (F.pmod(F.hash("id"), F.lit(4)) == 0).alias("tune")), "labels")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = materialize(base.join(F.broadcast(rows), "id").select("text", "label", "tune"), "labelled")
    counted = labelled.where("not tune")
    marked = base.join(F.broadcast(rows.where("not tune")), "id", "left")
    tree = materialize(nodes(word_counts(marked, "text", "label")), "nodes")
    totals = tuple(int(x or 0) for x in tree.where("level = 0").agg(F.sum("toxic"), F.sum("ordinary"), F.sum("types")).first())
    table = ratios(tree, totals, discount)

    def sorted_by_key(rows: DataFrame) -> pd.DataFrame:
        got = rows.toArrow().to_pandas()
        got["key"] = got["key"].to_numpy(np.int64).view(np.uint64)
        return got.sort_values("key", ignore_index=True)

    words = sorted_by_key(table.where(F.col("level") == len(PREFIXES) + 1).select("key", "toxic", "ordinary"))
    prefixes = sorted_by_key(table.where(F.col("level").between(1, len(PREFIXES))).groupBy("key").agg(F.max_by("rest", "level").alias("rest")))
    root = table.where("level = 0").first()
    after, grams = _with_expressions(*expressions(counted, "text", "label", min_docs), words, discount)
    model = Model((words["key"].to_numpy(), (words["toxic"] / words["ordinary"]).to_numpy()), (prefixes["key"].to_numpy(), prefixes["rest"].to_numpy()),
                  float(root["rest"]), after, grams, mix, pad)
    tune = labelled.where("tune").select("label", _statistic(F.col("text"), spark.sparkContext.broadcast(model)).alias("x")).toArrow().to_pandas()
    model.slope, model.limit = _curve(tune["x"].to_numpy(float), tune["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``, 0 to 1: higher, likelier toxic. Null and
    empty texts, and texts without a letter, have ratio 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    z = (_statistic(F.col(text_col), sent) - F.lit(model.limit)) * F.lit(model.slope)
    return docs.withColumn(out, 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z)))))


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    name, = unused(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).select(*docs.columns)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_args) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``.

    Labels of held-out ids (:func:`remainder` by 5 is 0; never a null id) are not
    learned from. Repeated rows and equal texts score alike; ids, languages,
    sources and other columns have no part in a score. Empty tables are fine.
    """
    learn = labels.where(remainder(F.col(id_col), 5) != 0)
    model = fit(docs, learn, id_col, text_col, **fit_args)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(F.col("id").alias(id_col), F.coalesce(remainder(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
