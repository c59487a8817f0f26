"""Session helpers: table loading, spreading of small inputs and shared-folder materialisation."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Intermediate folders of this driver, deleted by ``release`` or at its end.
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is missing and the session is local (tests, a laptop) a temporary folder is
    made and recorded in the session. A cluster without the setting is an error: folders of single
    machines would lose rows silently.
    """
    key = "spark.checkpoint.dir"
    got = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not got:
        got = spark.conf.get("pagewright.shared.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} must name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("pagewright.shared.dir", got)
    return got.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, to be deleted when this driver ends."""
    path = f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete the intermediate folders made so far; results that still read them must be done."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone
            jvm, own = spark.sparkContext._jvm, spark.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = own.hadoopConfiguration() if own else jvm.org.apache.hadoop.conf.Configuration()  # a stopped session has none
            target.getFileSystem(conf).delete(target, True)


atexit.register(release)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut by a table that
    every executor can read, so a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, if the input is so small and in so few files that its scan would give
    fewer tasks than there are cores (one small file is one task). What moves is bounded by cores times
    the bytes of a scan task; larger inputs, and those in as many files as cores, stay where they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    unit = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b") or "128m"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if cores == 1 or size >= cores * unit or len(df.inputFiles()) >= cores:  # files are only listed for small inputs
        return df
    return df.repartition(cores)
