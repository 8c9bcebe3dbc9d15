"""The ``opN_<name>`` queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blotter.llm import bpe, decontam, lexical, licenses, packing, quality_clf, quality_rules, secrets, simhash, toxicity, url_filter, warc, whitening
from blotter.llm.common import importable, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op5_decontamination", decontam.SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole document."""
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labels outside a fold of five."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secrets.secret_scan(read_table(spark, sf_dir, "documents"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens from the pieces of all documents."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op7_quality_rules", quality_rules.SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and adaptive verdicts of all documents."""
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels outside a fold of three."""
    return quality_clf.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op1_url_filter", url_filter.sql())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.url_filter(read_table(spark, sf_dir, "pages"))


@query("op4_warc", warc.SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by the index."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


@query("op6_license_scan", licenses.sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in the lines and whole texts of all documents."""
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whitening.components_of(read_table(spark, sf_dir, "embeddings"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the texts that they decode to, as digests."""
    return bpe.digests(read_table(spark, sf_dir, "documents"))


@query("op13_lexical_search", lexical.SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
