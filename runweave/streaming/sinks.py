"""Convergent sinks: a repeated micro-batch overwrites its own folder, so at-least-once delivery ends in one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runweave.operators.events import append_new
from runweave.operators.runs import first_by


def _so_far(spark: SparkSession, path: str, like: DataFrame, batch: int) -> DataFrame:
    """Rows of the batches before this one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or batch == 0:
        return like.limit(0)
    return spark.read.option("basePath", path).schema(f"{', '.join(f'`{c}` {t}' for c, t in like.dtypes)}, batch int").parquet(path).where(F.col("batch") < batch).drop("batch")


def append_events(stream: DataFrame, path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """New ids get the next sequence numbers; duplicates get none and use none up. One folder a batch."""

    def write(batch: DataFrame, n: int) -> None:
        log = _so_far(batch.sparkSession, path, batch.withColumn("seq", F.lit(0).cast("long")), n)
        append_new(log, batch, order).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_runs(stream: DataFrame, path: str, checkpoint: str, key: str, arrival: str) -> StreamingQuery:
    """The latest row of each key as a whole table per batch; rows that are not terminal are refused."""

    def write(batch: DataFrame, n: int) -> None:
        good = batch.where(F.col("state").isin("Completed", "Failed"))
        prior = _so_far(batch.sparkSession, path, good, n) if n == 0 else batch.sparkSession.read.schema(good.schema).parquet(f"{path}/batch={n - 1}")
        first_by(prior.unionByName(good), [key], [F.desc(arrival)]).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
