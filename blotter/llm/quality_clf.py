"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Statistics of a text are JVM column expressions. Trees of a random forest are
grown on labelled rows, every path from a root to a node is a conjunctive rule
``statistic <= or > threshold and ...``, and a logistic regression with an
L1 penalty weighs the rules; most weights are zero. The rules that stay, and
their weights, are one Spark column over the statistics, so scoring is a plain
projection. Fitting takes at most ``max_labelled`` labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters whose share of a text is a statistic.
CHARS = {"symbols": "#*$%&<>", "bars": "|", "bangs": "!?", "upper": UPPER, "digits": "0123456789", "stops": ".", "commas": ",;:", "at": "@/\\_=+"}
STATISTICS = (*CHARS, "log_words", "word_length", "distinct_words", "top_word_lines", "dup_lines", "words_a_line")

Rule = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", threshold), all of them


def statistics(docs: DataFrame, text_col: str, keep: dict[str, str]) -> DataFrame:
    """Columns ``keep`` (new name: column) and one double per statistic, never null."""
    t = F.col("t")
    df = docs.select(*(F.col(c).alias(n) for n, c in keep.items()), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    shares = {name: (F.char_length(t) - F.char_length(F.translate(t, chars, ""))) / size for name, chars in CHARS.items()}
    df = df.select(*keep, *(c.alias(n) for n, c in shares.items()), F.char_length(t).alias("chars"),
                   F.filter(F.split(t, r"\s+"), lambda w: w != "").alias("words"), F.filter(F.split(t, "\n"), lambda x: x != "").alias("lines"))
    words, lines = (F.greatest(F.size(c), F.lit(1)).cast("double") for c in ("words", "lines"))
    firsts = F.transform("lines", lambda x: F.substring_index(x, " ", 1))
    return df.select(*keep, *CHARS, F.log1p(F.size("words")).alias("log_words"), (F.col("chars") / words).alias("word_length"),
                     (F.size(F.array_distinct("words")) / words).alias("distinct_words"),
                     (F.size(F.array_distinct(firsts)) / lines).alias("top_word_lines"),
                     (1 - F.size(F.array_distinct("lines")) / lines).alias("dup_lines"), (words / lines).alias("words_a_line"))


@dataclass
class Ensemble:
    """Weighted rules; without any, the score is the prior's."""

    rules: list[tuple[Rule, float]] = field(default_factory=list)
    bias: float = 0.0

    def column(self) -> Column:
        """The score as a column over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for i, op, bound in rule:
        c = F.col(STATISTICS[i])
        out = out & (c <= bound if op == "<=" else c > bound)
    return out


def tree_rules(text: str) -> list[Rule]:
    """Paths to all nodes but the root, from a tree's ``toDebugString``."""
    path: list[tuple[int, tuple[int, str, float]]] = []
    out = []
    for line in text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, (int(m[2]), m[3], float(m[4]))))
            out.append(_tight([p[1] for p in path]))
    return out


def _tight(tests) -> Rule:
    """One bound per statistic and side."""
    best: dict[tuple[int, str], float] = {}
    for i, op, bound in tests:
        old = best.get((i, op), bound)
        best[i, op] = min(old, bound) if op == "<=" else max(old, bound)
    return tuple((i, op, b) for (i, op), b in sorted(best.items()))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 20_000,
        trees: int = 20, depth: int = 4, l1: float = 0.001, seed: int = 7) -> Ensemble:
    """Learn from ``stats`` (columns ``id`` and the statistics) and ``labels``,
    all of whose rows may be learned from; at most ``max_labelled`` are, by a
    hash of the id. Rows with a null id or label are left out; of several labels
    of an id the largest holds. One class only gives its prior."""
    rows = (labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("double").alias("label"))
            .where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))
    share = min(1.0, max_labelled / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(max_labelled)
    values = array_to_vector(F.array(*STATISTICS))
    train = materialize(stats.join(F.broadcast(materialize(rows, "labels")), "id").select("label", *STATISTICS), "train")
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return Ensemble(bias=4.0 if n and ones else (-4.0 if n else 0.0))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="values", featureSubsetStrategy="onethird")
    grown = forest.fit(train.select("label", values.alias("values")))
    rules = list(dict.fromkeys(r for t in grown.trees for r in tree_rules(t.toDebugString)))
    if not rules:
        return Ensemble(bias=0.0)
    held = array_to_vector(F.array(*(condition(r).cast("double") for r in rules)))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=l1, featuresCol="held", maxIter=200, standardization=False)
    fitted = lasso.fit(materialize(train.select("label", held.alias("held")), "rules"))
    weights = fitted.coefficients.toArray().tolist()
    return Ensemble([(r, w) for r, w in zip(rules, weights) if w], float(fitted.intercept))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_args) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``.

    Labels of held-out ids (crc32 of the id as text modulo 3 is 1; never a null
    id) are not learned from. Null and empty texts have statistics like any
    other text. Repeated rows score alike, and only the text has a part in a
    score. Empty tables are fine; other columns are ignored.
    """
    mod = lambda c: F.crc32(c.cast("string").cast("binary")) % 3
    stats = materialize(statistics(docs, text_col, {"id": id_col}), "statistics")
    model = fit(stats, labels.where(mod(F.col(id_col)) != 1), id_col, **fit_args)
    scored = stats.withColumn("score", model.column())
    return scored.select(F.col("id").alias(id_col), F.coalesce(mod(F.col("id")) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
