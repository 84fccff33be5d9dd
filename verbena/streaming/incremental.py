"""Incremental forms of batch operators on Structured Streaming; state and progress lie in the query's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import parts


def folder_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_counts(stream: DataFrame, by: str, order: str, values: Sequence[str]) -> DataFrame:
    """Per key the running count and the values of the first row by ``order``; both merge across batches."""
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.min_by(F.struct(*values), F.col(order)).alias("first"))


def windowed(stream: DataFrame, time: str, late: str, width: str, slide: str | None, by: Sequence[str], value: str) -> DataFrame:
    """Counts and means per window and key; rows later than the watermark are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over what is there and returns its result, written beside its checkpoint: of a complete result the last batch, else all batches."""
    out = f"{checkpoint}/{name}-result"

    def batch(part: DataFrame, k: int) -> None:
        part.write.mode("overwrite").parquet(f"{out}/batch={k}")  # a batch that is repeated after a failure overwrites itself

    q: StreamingQuery = df.writeStream.outputMode(mode).foreachBatch(batch).queryName(name).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = df.sparkSession
    batches = sorted(int(k.partition("=")[2]) for k in parts(spark, out))
    paths = [f"{out}/batch={k}" for k in (batches[-1:] if mode == "complete" else batches)]
    return spark.read.schema(df.schema).parquet(*paths)


def each_new_unit(stream: DataFrame, done_path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Resumable work: of each batch only units not yet done are worked on and appended; a batch that is repeated after a failure finds its own rows and adds none."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(list(keys))
        try:
            done = spark.read.parquet(done_path).select(*keys)
            new = new.join(done, list(keys), "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        work(new).write.mode("append").parquet(done_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
