"""Secret scans: patterns, and a battery of randomness tests. DataFrame
functions only.

Base spans are the leftmost non-overlapping matches of three patterns. The
method adds spans ``random``: long runs of characters in which encoded keys are
written. A run's encoding is inferred (hex, base32, base64 with either pair of
extra signs); a run without both a letter and a digit is a word or a number and
isn't tested. The parts of a run between slashes and plus signs, between hyphens
and underscores, and between all four are candidates as well: a key in a URL or
path is tested apart from the words around it, also where the whole run fits no
encoding. Of flagged candidates that overlap the longest stays. Under the hypothesis that the characters are drawn uniformly from
the encoding's alphabet, three tests give p-values: chi-squared over the
alphabet, the number of runs above and below the alphabet's middle, and the
lag-1 serial correlation. The smallest, times three (Bonferroni), is the run's p.

Length-aware false-discovery control: short runs have little power against
prose, long ones much. Runs are counted by stratum (encoding, length by factors
of two) in bins of p. Uniform p-values come from truly random runs, their number
is read from the upper half of the bins (Storey); what a bin holds beyond it is
structured text. In each stratum the flagged runs are those with p above the
least bound for which the estimated share of structured runs among the flagged
is at most ``fdr``. A stratum of fewer than ``MIN_RUNS`` runs also has the bound
of all lengths of its encoding together, or, if these are few too, of all
encodings: the lower one holds, as its own upper bins may be empty by chance.
Where all candidates of the corpus are few, a lone key can still be missed. The strata are few, whatever the number of documents; the
counts cover all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import materialize, unused

KINDS = ("assign", "access", "hex", "random")
#: Base patterns, the group whose length counts (0: the match), its least length.
BASE = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Longer patterns that match the same spans as the base pattern and its length.
SAME = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Parts of runs, also tested.
PARTS = (r"[A-Za-z0-9_-]{20,}={0,2}", r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9]{20,}={0,2}")
#: Alphabets of the encodings, in the order in which they are tried.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
BINS = 20
MIN_RUNS = 100  # of a stratum that needs no other's runs: five a bin
SPANS = "array<struct<start: bigint, end: bigint, kind: int>>"


def _matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the matches whose group has ``least`` characters, by code points.

    The pieces between the matches and the matches themselves give the places.
    """
    p = F.lit(pattern)
    found = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("g"),
                         F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.regexp_count(text, p)).alias("gap"))

    def add(done, x):
        start = done["at"] + x["gap"]
        end = start + F.char_length(x["m"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["g"]) >= least, F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))
    first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("out"))
    spans = F.aggregate(found, first, add, lambda done: done["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the error function's rational approximation (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(run: Column) -> Column:
    """``struct<encoding: int, n: int, p: double>`` of a run of characters;
    encoding -1 and p 0 for a run that isn't tested."""
    body = F.rtrim(run, F.lit("="))

    def tests(s: Column, alphabet: str) -> Column:
        k = len(alphabet)
        codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

        def stats(x: Column) -> Column:
            n = F.size(x).cast("double")
            counts = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), 2))
            chi = counts * k / n - n
            df = float(k - 1)
            z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
            high = F.transform(x, lambda v: (v >= k // 2).cast("int"))
            n1 = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
            n0 = n - n1
            pairs = F.zip_with(F.slice(high, 1, F.size(x) - 1), F.slice(high, 2, F.size(x)), lambda a, b: (a != b).cast("int"))
            turns = 1 + F.aggregate(pairs, F.lit(0), lambda a, v: a + v)
            mean = 2 * n0 * n1 / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            p_runs = F.when((n0 == 0) | (n1 == 0), F.pow(F.lit(0.5), n - 1)).otherwise(2 * _normal_tail(F.abs(turns - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))
            mid = (k - 1) / 2
            lag = F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: (a - mid) * (b - mid)), F.lit(0.0), lambda a, v: a + v)
            z_lag = lag / ((k * k - 1) / 12.0) / F.sqrt(n - 1)
            p = F.least(_normal_tail(z_chi), p_runs, 2 * _normal_tail(F.abs(z_lag)))
            return F.least(F.lit(1.0), 3 * p)
        return F.element_at(F.transform(F.array(codes), stats), 1)

    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]") & (F.char_length(body) >= 20)
    out = None
    for i, (_, pattern, alphabet) in reversed(list(enumerate(ENCODINGS))):
        one = F.struct(F.lit(i).alias("encoding"), F.char_length(body).alias("n"), tests(body, alphabet).alias("p"))
        none = F.struct(F.lit(-1).alias("encoding"), F.char_length(body).alias("n"), F.lit(0.0).alias("p")) if out is None else out
        out = F.when(body.rlike(pattern), one).otherwise(none)
    return F.when(mixed, out).otherwise(F.struct(F.lit(-1).alias("encoding"), F.char_length(body).alias("n"), F.lit(0.0).alias("p")))


def _stratum(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def scan(text: Column) -> Column:
    """``struct<base: spans, runs: spans with encoding, stratum, p>`` of a text
    without nulls."""
    empty = F.expr(f"cast(array() as {SPANS})")
    base = F.flatten(F.array(*(_matches(text, SAME.get(kind, pattern), group, least, i)
                               for i, (kind, pattern, group, least) in enumerate(BASE))))
    every = F.array_distinct(F.concat(*(_matches(text, pattern, 0, 0, len(BASE)) for pattern in (RUN, *PARTS))))
    runs = F.when(text.rlike(RUN), every).otherwise(empty)
    tested = F.transform(runs, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), battery(F.substring(text, r["start"].cast("int") + 1, (r["end"] - r["start"]).cast("int"))).alias("t")))
    return F.struct(F.array_sort(base).alias("base"), F.filter(tested, lambda r: r["t"]["encoding"] >= 0).alias("runs"))


def thresholds(scans: DataFrame, column: str, fdr: float) -> dict[tuple[int, int], int]:
    """Least flagged bin of p by stratum (encoding, length class); none: absent.

    One aggregate over all runs; its rows number at most encodings times length
    classes times bins.
    """
    runs = scans.select(F.explode(F.col(f"{column}.runs")).alias("r")).select(
        F.col("r.t.encoding").alias("e"), _stratum(F.col("r.t.n")).alias("l"),
        F.least(F.floor(F.col("r.t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[tuple[int, int], list[int]] = {}
    for r in runs.groupBy("e", "l", "bin").count().collect():
        counts.setdefault((r["e"], r["l"]), [0] * BINS)[r["bin"]] = r["count"]

    def bound(c: list[int]) -> int | None:
        random_per_bin = min(sum(c[BINS // 2:]) / (BINS - BINS // 2), sum(c) / BINS)
        for b in range(BINS):
            flagged = sum(c[b:])
            false = max(0.0, flagged - random_per_bin * (BINS - b))
            if flagged and random_per_bin > 0 and false <= fdr * flagged:
                return b
        return None

    out = {}
    for (e, n), c in counts.items():
        bounds = [bound(c)]
        if sum(c) < MIN_RUNS:
            alike = [sum(x) for x in zip(*(v for k, v in counts.items() if k[0] == e))]
            bounds.append(bound(alike if sum(alike) >= MIN_RUNS else [sum(x) for x in zip(*counts.values())]))
        found = [b for b in bounds if b is not None]
        if found:
            out[e, n] = min(found)
    return out


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", fdr: float = 0.1, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a column ``out``: all spans as
    ``(start, end, kind)`` in code points, by start, then kind."""
    columns = docs.columns if keep is None else keep
    found, text = unused(docs, "scan", "scan_text")
    scans = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(found, scan(F.col(text)))
    scans = materialize(scans.select(*columns, found), "secrets")
    least = thresholds(scans, found, fdr)
    flagged = F.lit(False)
    r_bin = lambda r: F.least(F.floor(r["t"]["p"] * BINS), F.lit(BINS - 1))

    def passes(r: Column) -> Column:
        ok = flagged
        for (e, n), b in sorted(least.items()):
            ok = ok | ((r["t"]["encoding"] == e) & (_stratum(r["t"]["n"]) == n) & (r_bin(r) >= b))
        return ok & ~F.exists(F.col(found)["base"], lambda s: (s["start"] < r["end"]) & (s["end"] > r["start"]))
    ranked = F.array_sort(F.transform(F.filter(F.col(found)["runs"], passes),
                                      lambda r: F.struct((r["start"] - r["end"]).alias("less"), r["start"].alias("start"), r["end"].alias("end"))))

    def longest(done: Column, r: Column) -> Column:
        span = F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(len(BASE)).alias("kind"))
        return F.when(F.exists(done, lambda s: (s["start"] < r["end"]) & (s["end"] > r["start"])), done).otherwise(F.concat(done, F.array(span)))
    added = F.aggregate(ranked, F.expr(f"cast(array() as {SPANS})"), longest)
    spans = F.array_sort(F.transform(F.concat(F.col(found)["base"], added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return scans.withColumn(out, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).select(*columns, out)


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.1) -> DataFrame:
    """One row per input row: id, counts of the base kinds, ``base_sha256`` and
    ``spans`` (``kind:start:end``, comma-joined).

    Null and empty texts have no spans. Spans of different kinds may overlap;
    added ones overlap no base span. At one start, kinds follow their order
    above. Repeated rows give repeated rows; empty tables an empty result.
    """
    marked = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fdr=fdr, keep=["id"])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    kinds = F.col("spans.kind")
    counts = [F.size(F.filter(kinds, F.lit(i).eqNullSafe)).cast("long").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    return marked.select(F.col("id").alias(id_col), *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[secret]", fdr: float = 0.1) -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mask``
    and ``chars_col``, if it is a column, set to the new length where text
    changed."""
    name, new = unused(docs, "spans", "masked")
    marked = with_spans(docs, text_col, name, fdr)
    text, spans = F.col(text_col), F.col(name)

    def add(done, s):
        gap = F.substring(text, done["at"].cast("int") + 1, F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        piece = F.when(s["end"] <= done["at"], "").when(s["start"] < done["at"], "").otherwise(F.concat(gap, F.lit(mask)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["text"], piece).alias("text"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    rest = lambda d: F.concat(d["text"], F.substring(text, d["at"].cast("int") + 1, 2147483647))
    masked = F.when(F.size(spans) > 0, F.aggregate(spans, first, add, rest)).otherwise(text)
    marked = marked.withColumn(new, masked)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(new).alias(c))
        elif c == chars_col:
            kind = docs.schema[c].dataType
            out.append(F.when(F.size(spans) > 0, F.char_length(F.col(new)).cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return marked.select(*out)
