"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a pattern over ``host + path`` in the common filter-list language:
``||`` anchors at a host or any of its subdomains, ``|`` at the start, ``^``
stands for a character that isn't a letter or digit, or an end, ``*`` for
anything, all else for itself. A rule's literal tokens are the runs of letters
and digits that every URL it fits must have whole. Each rule is filed under
the one of its tokens that the fewest URLs of the table have (counted over all
of them); rules without a token are filed under the empty token, which every
URL has. A URL's tokens fetch its candidate rules, and only those run their
regular expressions.

The index is joined by token to the distinct URLs' tokens, matches are reduced
per URL before they meet the rows again, so a URL or host that a third of the
rows share is no hot group. Rules are the caller's list, not data; where the
index is larger than ``broadcast_rules`` it isn't broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm.common import materialize, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported for host rules; others only give their verdict.
    Of the rules that fit a URL the one of highest (rank, name length) decides."""

    pattern: str
    verdict: str
    rank: int = 0
    name: str | None = None


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """``host`` and its subdomains, paths that start with ``path``."""
    return Rule(f"||{host}{path}", verdict, rank=1, name=host + path)


#: Production rules of the query: host rules, and patterns for the URLs that none of them fits.
HOST_RULES = (host_rule("org", "/", "allow"), host_rule("example.org", "/es/", "block"), host_rule("example.org", "/en/1", "block"),
              host_rule("com", "/fr/", "allow"), host_rule("com", "/de/", "block"))
PATTERN_RULES = (Rule("^cheap-pills^", "block"), Rule("^spam-farm^", "block"), Rule("^ads^", "block"), Rule("^adserver^", "block"),
                 Rule("^casino^", "block"), Rule("^viagra^", "block"), Rule("^porn^", "block"), Rule("*^track^*^click^", "block"))


def regex(pattern: str) -> str:
    """A pattern as a regular expression (of Java and RE2 alike)."""
    out, rest = "", pattern
    if rest.startswith("||"):
        out, rest = r"^([^/]*\.)?", rest[2:]
    elif rest.startswith("|"):
        out, rest = "^", rest[1:]
    for c in rest:
        out += {"*": r"(?s:.)*", "^": r"([^A-Za-z0-9]|^|\z)"}.get(c) or re.sub(r"([^A-Za-z0-9_/\s])", r"\\\1", c)
    return out


def tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that stand whole in every URL that fits: both
    neighbours in the pattern are literal signs, ``^`` or an anchor."""
    body = pattern.lstrip("|")
    out = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        before = pattern.startswith("|") if m.start() == 0 else body[m.start() - 1] != "*" and body[m.start() - 1].isascii()
        after = m.end() < len(body) and body[m.end()] != "*" and body[m.end()].isascii()
        if before and after:
            out.append(m[0].lower())
    return sorted(set(out))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def url_tokens(target: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased, and the empty token."""
    found = F.regexp_extract_all(F.translate(target, UPPER, LOWER), F.lit(TOKEN), F.lit(0))
    return F.array_union(F.array(F.lit("")), found)


def rule_index(spark: SparkSession, rules: list[Rule], seen: DataFrame, small: bool = True) -> DataFrame:
    """``(token, regex, verdict, rank, name)``, a row per rule; ``seen`` has the
    tokens of all URLs, one row (``token``, ``n``) for each and copy count. Tokens
    of rules are broadcast if ``small``; else tokens are summed before they meet,
    so that a frequent one is no hot group."""
    filed = [(i, t, regex(r.pattern), r.verdict, r.rank, r.name) for i, r in enumerate(rules) for t in (tokens(r.pattern) or [""])]
    table = spark.createDataFrame(filed, "rule int, token string, regex string, verdict string, rank int, name string")
    wanted = table.select("token").distinct()
    seen = seen.join(F.broadcast(wanted), "token") if small else seen
    counts = seen.groupBy("token").agg(F.sum("n").alias("n"))
    least = (table.join(counts, "token", "left").groupBy("rule", "regex", "verdict", "rank", "name")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best")))
    return least.select(F.col("best.token").alias("token"), "regex", "verdict", "rank", "name")


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", broadcast_rules: int = 20_000) -> DataFrame:
    """``pages`` with the columns ``host``, ``path``, ``rule``, ``verdict`` in
    place of columns of these names. Ties of rank and length go by name, then
    ``block`` over ``allow``."""
    spark = pages.sparkSession
    key, = unused(pages, "target")
    host, path = host_and_path(F.col(url_col))
    others = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*others, host.alias("host"), path.alias("path")).withColumn(key, F.concat("host", "path"))
    urls = materialize(rows.groupBy(F.col(key).alias("target")).agg(F.count("*").alias("n")), "urls")
    split = urls.select("target", "n", F.explode(url_tokens(F.col("target"))).alias("token"))
    small = len(rules) <= broadcast_rules
    index = materialize(rule_index(spark, rules, split, small), "rules")
    index = F.broadcast(index) if small else index
    fits = split.join(index, "token").where(F.expr("target rlike regex"))
    order = F.struct("rank", F.coalesce(F.length("name"), F.lit(0)).alias("size"), F.coalesce("name", F.lit("")).alias("text"), "verdict", "name")
    best = fits.groupBy("target").agg(F.max(order).alias("best"))
    met = rows.join(best.withColumnRenamed("target", key + "_"), F.col(key) == F.col(key + "_"), "left")
    return met.select(*others, "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None, **args) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    Null URLs, and those without ``://``, have an empty host and path and no
    rule. Paths keep their case. Repeated rows give repeated rows; empty tables
    an empty result; other columns are ignored.
    """
    rules = [*HOST_RULES, *PATTERN_RULES] if rules is None else rules
    return judge(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules, "url", **args).select(
        F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def sql() -> str:
    """The query in DuckDB's SQL."""
    fits = lambda r: f"regexp_matches(host || path, '{regex(r.pattern)}')"
    longest = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    cases = lambda f: " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in longest)
    block = " OR ".join(fits(r) for r in PATTERN_RULES)
    return rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(r, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest)
SELECT page_id, host, path, CASE {cases(lambda r: r.name)} END AS rule,
       CASE {cases(lambda r: r.verdict)} WHEN {block} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""
