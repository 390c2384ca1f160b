"""Streaming: the batch functions over a folder that grows. Sums are mergeable, so the state is one row for each motif."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon import schemas
from quillon.operators import parse, trees


def corpus_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.CORPUS).parquet(path)


def motif_counts(corpus: DataFrame) -> DataFrame:
    """domain, source, pattern, cnt in update mode."""
    parses = parse.parse_constituency(corpus)
    return trees.partial_counts(parses, ["domain", "source"]).groupBy("domain", "source", "pattern").agg(F.sum("cnt").alias("cnt"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of a stream with a time column `ts`; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return counts.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
