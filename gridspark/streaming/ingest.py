"""Structured Streaming around the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridspark.plans import workflows
from gridspark.sources import workbook


def workbook_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Workbook files as they come into a folder."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def audit_stream(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Audits each micro-batch of workbooks; a batch's findings replace those of an earlier try of the same batch.  A batch in which a rule fails ends the query and is not written."""

    def write(batch: DataFrame, number: int) -> None:
        workflows.audit(workbook.audit_source(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(events: DataFrame, time_column: str, keys: list[str], value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts, sums and non-blank values in tumbling windows, by keys; rows later than the watermark are dropped.  Works on streams and tables."""
    when = F.window(F.col(time_column).cast("timestamp"), size)
    timed = events.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late)
    return timed.groupBy(when.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n_rows", "n_values", "total")
