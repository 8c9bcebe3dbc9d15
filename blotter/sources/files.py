"""CSV / text sources and sinks.

Readers always declare a schema (no inference pass over the data); the
raw layout of the reference is headered CSV with text dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions.timeparts import TEXT_TS_FORMAT, parse_text_ts

INCIDENT_TEXT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("measure", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Headered CSV with a declared schema (quotes and embedded commas handled)."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, partition_by: Sequence[str] = ()) -> None:
    """Distributed CSV sink (one file per task, optional partition folders)."""
    w = df.write.mode("overwrite").option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink, e.g. a lookup table partitioned by day (L1 prunes to one folder)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_serving_table(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None, bloom: Sequence[str] = (),
                        row_group_bytes: int = 1 << 20) -> None:
    """L1's layout: Parquet sorted by ``keys`` over all files (range partitions, sampled
    bounds), in small row groups, with Bloom filters on the columns ``bloom``.

    A request for one combination of leading keys finds its rows in neighbouring row
    groups: the others' minima and maxima exclude them, as the Bloom filters exclude
    groups without a value of another column. Rows of one combination aren't split
    over files (range partitions hold equal keys together).
    """
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    w = dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    w = w.option("parquet.block.size.row.check.min", 100).option("parquet.page.size", 64 << 10).option("parquet.page.size.row.check.min", 100)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def write_incident_csv(incidents: DataFrame, path: str) -> None:
    """Incidents in the reference's raw layout: text dates ``MM/dd/yyyy hh:mm:ss a``."""
    write_csv(incidents.select(F.col("id").cast("string").alias("id"),
                               F.date_format("ts", TEXT_TS_FORMAT).alias("date"),
                               "district", "label", F.col("measure").cast("string").alias("measure")),
              path)


def read_incident_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 + T1 + P3: raw all-string incidents parsed into the canonical model."""
    raw = read_csv(spark, path, INCIDENT_TEXT_SCHEMA)
    return raw.select(F.col("id").try_cast("long").alias("id"), parse_text_ts("date").alias("ts"),
                      "district", "label", F.col("measure").try_cast("double").alias("measure"))


def read_incident_csv_checked(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 with quarantine: the incidents of well-formed records, and the others as
    ``(file, record, reason)``.

    A record goes to quarantine whole, as it stood in the file, if it has too few or
    too many fields (reason ``fields``) or a text that is no ``id``, ``date`` or ``measure``;
    empty fields are nulls and stay. No record is in both or in neither.
    """
    schema = T.StructType([*INCIDENT_TEXT_SCHEMA.fields, T.StructField("_record", T.StringType())])
    # all fields are parsed whatever columns are asked for, else their number isn't checked
    raw = (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnPruning", "false")
           .option("columnNameOfCorruptRecord", "_record").csv(path))
    parsed = {"id": F.col("id").try_cast("long"), "date": parse_text_ts("date"), "measure": F.col("measure").try_cast("double")}
    reason = F.when(F.col("_record").isNotNull(), "fields")
    for name, value in parsed.items():
        reason = reason.when(F.col(name).isNotNull() & value.isNull(), name)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"), reason.alias("reason"))
    good = rows.where("reason IS NULL").select(parsed["id"].alias("id"), parsed["date"].alias("ts"), "district", "label", parsed["measure"].alias("measure"))
    text = F.coalesce("_record", F.concat_ws(",", *(F.coalesce(F.col(f.name), F.lit("")) for f in INCIDENT_TEXT_SCHEMA.fields)))
    return good, rows.where("reason IS NOT NULL").select("file", text.alias("record"), "reason")


def read_delimited_lines(spark: SparkSession, path: str, n_fields: int, sep: str = ",") -> DataFrame:
    """S3: text lines split into at most ``n_fields`` fields (``split`` with a limit).

    Kept for raw dumps without quoting; use :func:`read_csv` when fields may
    contain quoted separators.
    """
    lines = spark.read.text(path)
    parts = F.split(F.col("value"), sep, n_fields)
    return lines.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(f"c{i}") for i in range(n_fields)])
