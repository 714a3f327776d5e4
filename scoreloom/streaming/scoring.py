"""Calibration of a stream of predictions, and a resumable scored log."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import apply_affine


def calibrated_stream(stream: DataFrame, line: DataFrame, offsets: DataFrame, column: str) -> DataFrame:
    """Stateless: both tables are static, so each batch is one map with broadcast joins."""
    return apply_affine(stream, line, offsets, ["trait"], column)


#: Keyed state on disk, whose memory on an executor is bounded.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _run(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; it lies in the checkpoint and goes with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/run")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.text(f"{checkpoint}/run")
    return spark.read.text(f"{checkpoint}/run").first()[0]


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "id", work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends rows whose key the log ``path`` does not hold yet, after ``work`` (a scorer, say) has seen them; the first row of a key counts, in one batch any.

    Keys that came are state on disk, so a batch costs what its rows cost, however long the log is. A batch is written under its
    run and number: one that runs again, as after a crash, writes the same place again and adds nothing. Without its
    checkpoint a log goes on as another run, which leaves out the keys of the runs before; only then is the log read.
    """
    spark = stream.sparkSession
    run = _run(spark, checkpoint)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    others = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    others = [f"{path}/{f}" for f in others if f.startswith("run=") and f != f"run={run}"]
    fresh = stream.join(spark.read.option("recursiveFileLookup", "true").parquet(*others).select(key), key, "left_anti") if others else stream
    fresh = fresh.dropDuplicates([key])

    def write(batch: DataFrame, i: int) -> None:
        (work(batch) if work else batch).write.mode("overwrite").parquet(f"{path}/run={run}/batch={i}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        return fresh.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # the query has its own copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log, with the run and batch that wrote them."""
    return spark.read.option("basePath", path).parquet(f"{path}/run=*/batch=*")


def error_stream(stream: DataFrame, *, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed n, rmse and bias by trait; rows later than the watermark are left out."""
    e = F.col("pred") - F.col("gold")
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "trait").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")).select("w.start", "w.end", "trait", "n", "rmse", "bias")
