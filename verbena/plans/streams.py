"""Streaming queries over the events table; extensions of the chunked scan and the resumable log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..runtime import run_folder, table
from ..streaming import incremental as I

QUERIES, ORACLE = {}, {}


def _fresh(spark, name: str) -> tuple[str, str]:
    tag = uuid.uuid4().hex
    return f"{name}_{tag}", f"{run_folder(spark)}/{name}-{tag}"


def running_first_seen(spark, sf_dir):
    """Counts and first value per event type, as a streaming aggregate over all files."""
    t = table(spark, sf_dir, "events")
    name, folder = _fresh(spark, "running")
    stream = I.folder_stream(spark, f"{sf_dir}/event[s].parquet", t.schema)
    got = I.run_available(I.running_counts(stream, "event_type", "event_id", ["user_id", "value"]), name, folder)
    return got.select("event_type", "n", F.col("first.user_id").alias("first_user"), F.col("first.value").alias("first_value"))


def done_units(spark, sf_dir):
    """Users worked off once each by a resumable streaming query, with their number of events in the batch of work."""
    t = table(spark, sf_dir, "events")
    _, folder = _fresh(spark, "units")
    stream = I.folder_stream(spark, f"{sf_dir}/event[s].parquet", t.schema).select("user_id", "event_type")
    q = I.each_new_unit(stream, folder + "/done", ["user_id", "event_type"], lambda df: df.select("user_id", "event_type"), folder + "/log")
    q.awaitTermination()
    return spark.read.parquet(folder + "/done")


QUERIES |= {"running_first_seen": running_first_seen, "done_units": done_units}
ORACLE |= {
    "running_first_seen": "select event_type, count(*) n, arg_min(user_id, event_id) first_user, arg_min(value, event_id) first_value from events group by all",
    "done_units": "select distinct user_id, event_type from events",
}
