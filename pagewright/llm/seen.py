"""Has this key been seen before? A keyed streaming state that never forgets.

The keys of the snapshots and of the requests are one stream. Its state is partitioned by a hash of the
key into ``BUCKETS`` groups; a group's state holds its seen keys, each with the smallest arrival order it
came with, in RocksDB on the executors' disks, checkpointed to the shared folder. There is no watermark and
no timeout, so nothing expires.

Each micro-batch puts its rows to the state and emits every request that turns out to be a repeat: its key
is in the state with an earlier arrival, or an earlier request of the batch has it. Batches may bring
requests in any order: where an earlier request comes late, the one that had counted as first is emitted as
a repeat then, so after each batch the emitted rows are the exact answers for all that came so far.

A key that makes up a third of all rows doesn't heat a task: before the shuffle each Arrow batch of rows
keeps one row of a key for the state; the others are repeats for certain and travel by their own ids.

Answers are exact; ``p3_wrong`` recomputes them by another way over all rows and counts the differences.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import fresh_path, table

#: Arrival order of keys that were there before the first request.
BEFORE = -1
#: Groups of the keyed state. A touched group's keys are read and written in each batch, so a state of
#: billions of keys wants more groups; the number is fixed for the life of a state.
BUCKETS = 2048
#: Files of each source that a micro-batch takes at most.
FILES = 4096
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: White space that is trimmed from keys.
WHITE = r"^[\s\p{Z}\x{0085}\x{FEFF}]+|[\s\p{Z}\x{0085}\x{FEFF}]+$"


def key_of(fingerprint: Column) -> Column:
    """A fingerprint, trimmed and in lower case; null for a null or blank one."""
    trimmed = F.when(fingerprint.rlike(WHITE), F.regexp_replace(fingerprint, WHITE, "")).otherwise(fingerprint)
    return F.nullif(F.lower(trimmed), F.lit(""))


def packed(key: Column) -> Column:
    """A key as bytes, half as long if it is a hexadecimal digest; one to one."""
    digest = key.rlike(r"^([0-9a-f]{2})+$")
    return F.when(digest, F.concat(F.unhex(F.lit("00")), F.unhex(F.when(digest, key)))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(key, "UTF-8")))


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _combined(keys: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key, arrival): of each key of an Arrow batch its earliest row, in the key's bucket; the other
    requests of the key, which are repeats, without a key and in buckets of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[bytes, int] = {}
            later: list[int] = []
            for k, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = best.get(k)
                if got is None:
                    best[k] = a
                elif a != got:
                    best[k] = min(a, got)
                    if max(a, got) != BEFORE:
                        later.append(max(a, got))
            yield pa.RecordBatch.from_arrays([pa.array([*best, *[None] * len(later)], pa.binary()), pa.array([*best.values(), *later], pa.int64())], names=["key", "arrival"])

    rows = keys.where("key is not null and arrival is not null").select("key", "arrival").mapInArrow(run, "key binary, arrival long")
    own = F.when(F.col("key").isNull(), F.xxhash64("arrival")).otherwise(F.xxhash64("key"))
    return rows.select(F.pmod(own, F.lit(buckets)).cast("int").alias("bucket"), "key", "arrival")


def _load(blob: bytes | None) -> dict[bytes, int]:
    if not blob:
        return {}
    t = pa.ipc.open_stream(blob).read_all()
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


def _dump(known: dict[bytes, int]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.int64())], names=["k", "a"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _answer(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Repeats among the rows of a bucket, and its seen keys brought up to date."""
    known = _load(state.get[0]) if state.exists else {}
    out: list[int] = []
    changed = False
    for f in frames:
        for k, a in zip(f["key"], f["arrival"].tolist(), strict=True):
            if k is None:
                out.append(a)
                continue
            k = bytes(k)
            first = known.get(k)
            if first is None or a < first:
                known[k] = a
                changed = True
                if first is not None and first != BEFORE:
                    out.append(first)  # had counted as the first
            elif a > first:
                out.append(a)
    if changed:
        state.update((_dump(known),))
    yield pd.DataFrame({"request_id": np.array(out, np.int64)})


def stream_repeats(keys: DataFrame, batches: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(request_id) of the requests of the streaming frame ``keys`` (key, arrival) that aren't the first of
    their key, each once; ``arrival`` is the request's id, or ``BEFORE`` for keys known from elsewhere.

    Runs the stream over all that there is. ``batches`` names a folder that keeps the checkpoint and the
    emitted rows, so that a later call goes on where this one ended; by default a new one under the shared
    folder. Null keys give nothing; two rows of one id are one request.
    """
    spark = keys.sparkSession
    root = batches or fresh_path(spark, "p3")

    def emit(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/repeats/batch={batch}")  # a batch done again replaces itself

    with _settings(spark, STATE):
        query = (
            _combined(keys, buckets)
            .groupBy("bucket")
            .applyInPandasWithState(_answer, "request_id long", "known binary", "append", "NoTimeout")
            .writeStream.outputMode("append")
            .option("checkpointLocation", f"{root}/answers")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    try:
        return spark.read.schema("request_id long, batch long").parquet(f"{root}/repeats").select("request_id").distinct()  # a row delivered again is answered again
    except Exception as e:  # no batch ran: there was no input
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "request_id long")


def first_arrivals(keys: DataFrame, batches: str | None = None) -> DataFrame:
    """(key, arrival): the first arrival of each key of the streaming frame ``keys`` (key, arrival), by a
    streaming aggregation; each batch emits the keys it touched, and the least of a key's rows counts.

    Runs the stream over all that there is and returns what it emitted. ``batches`` names a folder
    that keeps the checkpoint and the emitted table, so that a later call goes on where this one
    ended; by default a new one under the shared folder.
    """
    spark = keys.sparkSession
    root = batches or fresh_path(spark, "p3")

    def emit(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/first/batch={batch}")  # a repeated batch replaces itself

    with _settings(spark, STATE):
        query = (
            keys.where("key is not null")
            .groupBy("key")
            .agg(F.min("arrival").alias("arrival"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    try:
        return spark.read.schema("key binary, arrival long, batch long").parquet(f"{root}/first").groupBy("key").agg(F.min("arrival").alias("arrival"))
    except Exception as e:  # no batch ran: there was no input
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key binary, arrival long")


def _stream(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = table(spark, sf_dir, name).select(*columns.split()).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES)
    # a table is a file or a folder of files; a stream reads folders, or files by a pattern
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    return reader.parquet(f"{sf_dir}/{name}.parque[t]" if is_file else path)


def requests_with_key(df: DataFrame) -> DataFrame:
    """(request_id, key) of the requests that have a key and aren't forced."""
    keyed = df.where(F.col("request_id").isNotNull() & ~F.coalesce("dont_filter", F.lit(False)))
    return keyed.select("request_id", packed(key_of(F.col("fingerprint"))).alias("key")).where("key is not null")


def all_keys(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(key, arrival) of snapshots and requests, streaming or not. Null lists and keys give nothing."""
    seen = snapshots.select(F.explode("seen").alias("fingerprint")).select(packed(key_of(F.col("fingerprint"))).alias("key"), F.lit(BEFORE).cast("long").alias("arrival"))
    return seen.unionByName(requests_with_key(requests).select("key", F.col("request_id").alias("arrival"))).where("key is not null")


def repeats(requests: DataFrame, first: DataFrame) -> DataFrame:
    """(request_id) of the requests with a key that aren't its first arrival."""
    return requests_with_key(requests).select("request_id").join(first.select(F.col("arrival").alias("request_id")).where(F.col("request_id") >= 0), "request_id", "left_anti")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = all_keys(
        _stream(spark, sf_dir, "scheduler_requests", "request_id dont_filter fingerprint"),
        _stream(spark, sf_dir, "scheduler_snapshots", "seen"),
    )
    return stream_repeats(keys)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id) of requests whose key was seen before."""
    return _found(spark, sf_dir)


def p3_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_requests, n_repeats, n_wrong, wrong_rate): the stream's answers against a recomputation
    by one batch aggregation over all rows."""
    requests = table(spark, sf_dir, "scheduler_requests")
    first = all_keys(requests, table(spark, sf_dir, "scheduler_snapshots")).groupBy("key").agg(F.min("arrival").alias("arrival"))
    truth = repeats(requests, first).select("request_id", F.lit(1).alias("truth"))
    got = _found(spark, sf_dir).select("request_id", F.lit(1).alias("got"))
    both = requests.select("request_id").join(got, "request_id", "left").join(truth, "request_id", "left")
    wrong = F.sum((F.coalesce("got", F.lit(0)) != F.coalesce("truth", F.lit(0))).cast("long"))
    return both.agg(F.count("*").alias("n_requests"), F.count("got").alias("n_repeats"), F.coalesce(wrong, F.lit(0)).alias("n_wrong")).withColumn(
        "wrong_rate", F.when(F.col("n_requests") > 0, F.col("n_wrong") / F.col("n_requests")).otherwise(0.0)
    )


_REPEATS = """with r as (select request_id, nullif(lower(trim(fingerprint, ' ' || chr(9) || chr(10) || chr(13))), '') k from scheduler_requests where not dont_filter),
s as (select distinct lower(trim(unnest(seen))) k from scheduler_snapshots)
select request_id from (select request_id, k, row_number() over (partition by k order by request_id) n from r where k is not null) where n > 1 or k in (select k from s where k is not null)"""
SQL = {
    "p3_found": _REPEATS,
    "p3_wrong": f"select (select count(*) from scheduler_requests) n_requests, count(*) n_repeats, 0::bigint n_wrong, 0.0::double wrong_rate from ({_REPEATS})",
}
