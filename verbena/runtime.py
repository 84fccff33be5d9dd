"""Session helpers shared by all operators: tables, durable intermediates, size-checked joins."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows a side may have, and bytes as rows in memory, to be broadcast; beyond either, joins are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Replicas of the small side where a shuffled join is salted: where adaptive execution does not split skewed partitions.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own in local mode, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "verbena-checkpoints")


_cleaned: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """This application's folder below the shared root; it is removed as the driver's Python ends."""
    sc = spark.sparkContext
    folder = f"{shared_root(spark)}/verbena/{sc.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, sc, folder)
    return folder


def _remove(sc, folder: str) -> None:
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; its folder stays
        pass


def materialise(df: DataFrame, label: str, partition_by: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """Cut lineage by a written table in the shared folder (or ``folder``), which survives the loss of executors."""
    spark = df.sparkSession
    path = f"{folder or run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return written(spark, path, df.schema, partition_by)


def written(spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str] = ()) -> DataFrame:
    """A table as ``materialise`` left it; its path is kept for ``discard``."""
    ordered = StructType([f for f in schema if f.name not in partition_by] + [schema[c] for c in partition_by])
    got = spark.read.schema(ordered).parquet(path).select(*schema.names)
    got.written_at = path
    return got


def discard(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing reads any more; other tables are left alone."""
    for t in tables:
        path = getattr(t, "written_at", None)
        if path:
            _remove(t.sparkSession.sparkContext, path)


def parts(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes per folder name (``column=value``) right below a written table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(root) if s.isDirectory() and "=" in s.getPath().getName()}


def at_most(df: DataFrame, n: int) -> bool:
    """Whether df has at most n rows; counts no further than n + 1."""
    return df.limit(n + 1).count() <= n


def _bytes(value: Column, kind: DataType) -> Column:
    """About the bytes that a value takes in a row in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, MapType):
        return _bytes(F.map_keys(value), ArrayType(kind.keyType)) + _bytes(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, MapType, ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(0)) + 24
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    return F.lit(16 if kind.typeName() == "decimal" else 8)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int | None = None) -> bool:
    """Whether df is small enough, in rows and in bytes, to be held by the driver and every executor."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(32))
    rows, total = df.agg(F.count("*"), F.sum(size.cast("bigint"))).first()
    return rows <= max_rows and (total or 0) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def _splits_skew(spark: SparkSession) -> bool:
    return all(spark.conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "skewJoin.enabled"))


def checked_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, salt_on: Sequence[str] = ()) -> DataFrame:
    """Join that broadcasts ``small`` only after its rows and bytes were counted; else a sort-merge join, asked for by a hint, for Spark
    would broadcast by the size of compressed files. Adaptive execution splits its skewed partitions; where that is off, hot keys are salted.

    ``small`` should be cheap to count (a written table). ``how`` is inner, left, left_semi or left_anti:
    each row of ``big`` meets exactly one replica of ``small``, so salting changes no result.
    """
    keys = list(keys)
    if fits(small, max_rows):
        return big.join(F.broadcast(small), keys, how)
    if _splits_skew(big.sparkSession):
        return big.join(small.hint("merge"), keys, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*(salt_on or big.columns)), F.lit(SALTS)).cast("int"))
    spread = small.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(spread.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the session's number of shuffle partitions, which AQE then leaves apart: for costly tasks over few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
