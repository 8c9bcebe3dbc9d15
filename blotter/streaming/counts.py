"""Structured Streaming form of the hourly count series (A2 + T4).

The reference is batch only; this runs the same per-district hourly count
that feeds the hourly forecast (C2) and the lookup (L1) incrementally over
arriving incident files: event-time windows with a watermark for late
rows, state kept by Spark's state store, checkpoint in the cluster's shared
checkpoint folder so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.operators.clean import latest_per_group
from blotter.session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def incident_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                    max_files: int = 1) -> DataFrame:
    """Event files arriving in ``folder`` as an incident stream (as ``incidents_e``);
    ``pattern`` is of file names. A path that is one file is streamed as the one file
    of its name in its folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path) and files.getFileStatus(path).isFile():
        folder, pattern = path.getParent().toString(), path.getName()
    raw = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
           .option("pathGlobFilter", pattern).parquet(folder))
    return raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                      F.lpad((F.col("user_id") % 25).cast("string"), 3, "0").alias("district"),
                      F.col("event_type").alias("label"))


def hourly_counts(stream: DataFrame, watermark: str | None = "2 hours") -> DataFrame:
    """Counts per district and event-time hour; rows later than the watermark are
    dropped. None: no row is late and no state is dropped, for the replay of a
    complete table, whose files need not be in the order of time."""
    kept = stream if watermark is None else stream.withWatermark("ts", watermark)
    return (kept.groupBy(F.window("ts", "1 hour").alias("w"), "district")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hour_ts"), "district", "n"))


def run_to_table(spark: SparkSession, agg: DataFrame, name: str, keys=("hour_ts", "district")) -> DataFrame:
    """Drive a streaming aggregate over everything available into a Parquet table.

    Update mode: each micro-batch writes the rows whose counts it changed into
    its own folder of the table (a batch that runs again overwrites its folder,
    so each counts once), the watermark drops state that can't change any more,
    and nothing comes to the driver. The result takes each key's last row.
    Table and checkpoint are new sub-folders of the shared folder.
    """
    base = scratch_path(spark, "streams", name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/table/batch={batch}")

    spark.createDataFrame([], agg.schema).write.parquet(f"{base}/table/batch=-1")  # a stream without rows
    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*agg.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/table")
    return latest_per_group(rows, list(keys), "batch").drop("batch")
