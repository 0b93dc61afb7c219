"""Incremental ingestion: new files are counted once, whatever stops and restarts in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.operators.domains import with_domain
from crawlscope.sources.readers import FLAT_SCHEMA


def ingest_domain_counts(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = FLAT_SCHEMA, url: str = "u", glob: str = "*.jsonl*") -> None:
    """Adds the files that `source` gained to the domain counts at `out`, and returns when they are in.

    The file source's log in `checkpoint` knows the finished files, the aggregation's state the counts; each micro-batch replaces `out`."""
    lines = spark.readStream.schema(schema).option("pathGlobFilter", glob).json(source)
    counts = with_domain(lines.select(F.col(url)), url).groupBy("domain").agg(F.count(F.lit(1)).alias("count"))
    put = lambda df, _: df.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def process_once(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Runs `work` on rows of new Parquet files and appends what it returns, exactly once for each micro-batch."""
    rows = spark.readStream.schema(schema).parquet(source)
    # A batch's own folder makes a repeated batch replace itself.
    put = lambda df, n: work(df).write.mode("overwrite").parquet(f"{out}/batch={n}")
    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and type: works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
