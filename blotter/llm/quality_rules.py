"""Quality rules with adaptive thresholds. DataFrame functions only.

Per document, ratios of its text (symbols and repeated words to words, repeated
lines to lines, characters per word) are computed in its own row. Their
distribution is kept per language and source in KLL quantile sketches, which
merge: a language's sketch is the merger of its sources', the whole table's
that of its languages'. A ratio is judged by the quartiles of the document's
language and source, of the language where the pair has fewer than ``min_rows``
documents, of the whole table where the language has:

    low = q25 - spread * max(q75 - q25, floor), high = q75 + spread * max(...)

The floor keeps groups without variation from rejecting small deviations.
Documents and thresholds are joined by language and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import materialize, unused

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: ratio: (least width of its middle half, whether low values are judged too)
RATIOS = {"symbols": (0.05, False), "repeats": (0.05, False), "dup_lines": (0.1, False), "word_length": (0.5, True)}
SKETCH_K = 4096


def _with(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns(cols)


def statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the base statistics as longs.

    Each step is a column of its own, so that arrays are computed once and not
    in the lambdas that use them. Repeated windows are found by sorting a
    document's 64-bit window hashes, in time n log n of its words.
    """
    t = F.col("t")
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = _with(df, words=F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
               lines=F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
               n_symbols=(F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"))
    df = df.select(*keep, "words", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    none = F.expr("cast(array() as array<bigint>)")
    hashes = F.when(F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(none)
    df = _with(df, grams=hashes).drop("words")
    placed = F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _with(df, placed=F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed)).drop("grams")
    again = F.filter("placed", lambda x, k: F.coalesce(F.get("placed", k - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get("placed", k + 1)["h"] == x["h"], F.lit(False)))
    df = _with(df, again=F.array_sort(F.transform(again, lambda x: x["i"]))).drop("placed")
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("again", first, lambda a, i: F.struct(
        (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _ratios() -> dict[str, Column]:
    n = F.col("n_words").cast("double")
    per_word = lambda c: F.when(n > 0, F.col(c) / n)
    return {"symbols": per_word("n_symbols"), "repeats": per_word("n_repeat_words"), "word_length": per_word("word_chars"),
            "dup_lines": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines"))}


def sketches(stats: DataFrame) -> DataFrame:
    """One KLL sketch per ratio, language and source, with the number of documents."""
    ratios = _ratios()
    aggs = [F.kll_sketch_agg_double(ratios[r], SKETCH_K).alias(r) for r in RATIOS]
    return stats.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *aggs)


def merged(per: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return per.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(r).alias(r) for r in RATIOS))


def _quartiles(r: str, prefix: str) -> list[Column]:
    return [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(r), F.lit(q))).alias(f"{prefix}_{r}_{name}")
            for q, name in ((0.25, "q1"), (0.75, "q3"))]


def thresholds(stats: DataFrame, min_rows: int, spread: float) -> DataFrame:
    """``(lang, source, low_*, high_*)``, a row for each language and source."""
    per = materialize(sketches(stats), "sketches")
    by_lang = merged(per, "lang")
    everything = merged(by_lang).select(*(c for r in RATIOS for c in _quartiles(r, "all"))).first()
    own = per.select("lang", "source", F.col("n").alias("own_n"), *(c for r in RATIOS for c in _quartiles(r, "own")))
    langs = by_lang.select(F.col("lang").alias("l"), F.col("n").alias("lang_n"), *(c for r in RATIOS for c in _quartiles(r, "lang")))
    both = own.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left")
    out = []
    for r, (floor, _) in RATIOS.items():
        q1, q3 = (F.when(F.col("own_n") >= min_rows, F.col(f"own_{r}_{q}")).when(F.col("lang_n") >= min_rows, F.col(f"lang_{r}_{q}"))
                  .otherwise(F.lit(everything[f"all_{r}_{q}"]).cast("double")) for q in ("q1", "q3"))
        width = F.greatest(q3 - q1, F.lit(floor)) * spread
        out += [(q1 - width).alias(f"low_{r}"), (q3 + width).alias(f"high_{r}")]
    return both.select("lang", "source", *out)


def judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: dict[str, str],
           min_rows: int = 50, spread: float = 3.0) -> DataFrame:
    """Statistics of all rows, columns ``keep`` (new name: column), ``base_failed`` and ``kept``."""
    text, = unused(docs, "t")
    base = docs.select(*(F.col(c).alias(n) for n, c in keep.items()), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                       F.col(text_col).alias(text))
    stats = materialize(statistics(base, text, [*keep, "lang", "source"]), "statistics")
    limits = materialize(thresholds(stats, min_rows, spread).select(F.col("lang").alias("l"), F.col("source").alias("s"), "*"), "thresholds").drop("lang", "source")
    met = stats.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    fine = F.lit(True)
    for r, value in _ratios().items():
        fine = fine & F.coalesce(value <= F.col(f"high_{r}"), F.lit(True))
        if RATIOS[r][1]:
            fine = fine & F.coalesce(value >= F.col(f"low_{r}"), F.lit(True))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return met.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & fine).alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", **limits) -> DataFrame:
    """One row per input row: id, statistics, ``base_failed``, ``kept``.

    Null and empty texts have no words and fail. Null languages and sources are
    groups like any other. A ratio equal to a threshold passes. Repeated rows
    count and are judged each; an empty table gives an empty result; columns
    other than the four named are ignored.
    """
    return judged(docs, text_col, lang_col, source_col, {"id": id_col}, **limits).withColumnRenamed("id", id_col)


#: The same in DuckDB's SQL, with exact quartiles: a sketch of fewer values than SKETCH_K is exact.
SQL = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS rid
  FROM documents),
grams AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY rid),
stats AS (
  SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)),
ratios AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbols, CASE WHEN n_words > 0 THEN n_repeat_words / n_words END AS repeats,
         CASE WHEN n_words > 0 THEN word_chars / n_words END AS word_length, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END AS dup_lines
  FROM stats),
own AS (
  SELECT lang, source, count(*) AS n, quantile_disc(symbols, [0.25, 0.75]) AS symbols, quantile_disc(repeats, [0.25, 0.75]) AS repeats,
         quantile_disc(word_length, [0.25, 0.75]) AS word_length, quantile_disc(dup_lines, [0.25, 0.75]) AS dup_lines
  FROM ratios WHERE n_words > 0 GROUP BY lang, source),
by_lang AS (
  SELECT lang, count(*) AS n, quantile_disc(symbols, [0.25, 0.75]) AS symbols, quantile_disc(repeats, [0.25, 0.75]) AS repeats,
         quantile_disc(word_length, [0.25, 0.75]) AS word_length, quantile_disc(dup_lines, [0.25, 0.75]) AS dup_lines
  FROM ratios WHERE n_words > 0 GROUP BY lang),
every AS (
  SELECT quantile_disc(symbols, [0.25, 0.75]) AS symbols, quantile_disc(repeats, [0.25, 0.75]) AS repeats,
         quantile_disc(word_length, [0.25, 0.75]) AS word_length, quantile_disc(dup_lines, [0.25, 0.75]) AS dup_lines
  FROM ratios WHERE n_words > 0),
q AS (
  SELECT r.*,
    CASE WHEN o.n >= 50 THEN o.symbols WHEN b.n >= 50 THEN b.symbols ELSE e.symbols END AS q_symbols,
    CASE WHEN o.n >= 50 THEN o.repeats WHEN b.n >= 50 THEN b.repeats ELSE e.repeats END AS q_repeats,
    CASE WHEN o.n >= 50 THEN o.word_length WHEN b.n >= 50 THEN b.word_length ELSE e.word_length END AS q_word_length,
    CASE WHEN o.n >= 50 THEN o.dup_lines WHEN b.n >= 50 THEN b.dup_lines ELSE e.dup_lines END AS q_dup_lines
  FROM ratios r LEFT JOIN own o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source
  LEFT JOIN by_lang b ON r.lang IS NOT DISTINCT FROM b.lang, every e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND symbols <= q_symbols[2] + greatest(q_symbols[2] - q_symbols[1], 0.05) * 3.0
         AND repeats <= q_repeats[2] + greatest(q_repeats[2] - q_repeats[1], 0.05) * 3.0
         AND dup_lines <= q_dup_lines[2] + greatest(q_dup_lines[2] - q_dup_lines[1], 0.1) * 3.0
         AND word_length <= q_word_length[2] + greatest(q_word_length[2] - q_word_length[1], 0.5) * 3.0
         AND word_length >= q_word_length[1] - greatest(q_word_length[2] - q_word_length[1], 0.5) * 3.0 AS kept
FROM q
"""
