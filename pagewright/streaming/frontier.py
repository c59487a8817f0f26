"""The frontier as a stream: requests in, each fingerprint once out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators.frontier import with_fingerprint

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def request_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of requests that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def new_requests(stream: DataFrame) -> DataFrame:
    """Requests that weren't seen before, whenever that was, in update mode: of each fingerprint the first
    request (the smallest id) of the first batch that brought it. Forced requests pass and leave no mark.

    The state is an aggregation by key, so a batch is reduced before it is shuffled and no key is hot. It has
    no watermark, since a URL may come back after any time; it lies on disk if the session uses the RocksDB
    provider, and its size is that of the distinct fingerprints. A batch's time is the same for all its rows:
    a key whose first and last time are the batch's own is new.
    """
    marked = with_fingerprint(stream)
    key = F.when(F.coalesce("dont_filter", F.lit(False)), F.concat(F.lit("forced "), F.col("request_id").cast("string"))).otherwise(F.col("fp"))
    timed = marked.withColumns({"__key": key, "__at": F.current_timestamp()}).where("__key is not null")
    first = F.min_by(F.struct(*marked.columns), F.struct("__at", "request_id")).alias("__request")
    found = timed.groupBy("__key").agg(first, F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    return found.where("__first = __last").select("__request.*")


def run(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append new requests to a parquet folder until all that is there is done, a folder for each batch, so a
    batch done again replaces itself. The session's own state provider is put back once the query has been
    started, since a query keeps the one it began with."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)

    def emit(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    try:
        return new_requests(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(emit).start()
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def arrival_counts(stream: DataFrame, late: str = "2 days", window: str = "1 hour") -> DataFrame:
    """(window, host, n): requests by hour of arrival and host; later ones than ``late`` are left out."""
    return stream.withWatermark("enqueued_at", late).groupBy(F.window("enqueued_at", window).alias("window"), "host").agg(F.count("*").alias("n"))
