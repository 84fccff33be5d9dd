"""Writers. Tables are written in parallel; the one-file forms are for reports whose rows were counted."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import first_gap
from ..runtime import at_most, spread

REPORT_ROWS = 100_000


def _report(df: DataFrame) -> DataFrame:
    if not at_most(df, REPORT_ROWS):
        raise ValueError(f"a report holds at most {REPORT_ROWS} rows; write a table instead")
    return df.coalesce(1)


def csv(df: DataFrame, path: str, append: bool = False, one_file: bool = False) -> None:
    (_report(df) if one_file else df).write.mode("append" if append else "overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def json_lines(df: DataFrame, path: str, one_file: bool = False) -> None:
    (_report(df) if one_file else df).write.mode("overwrite").json(path)


#: Folders among which the files of ``documents`` are dealt out, so that they are listed in parallel.
FOLDERS = 64


def documents(df: DataFrame, path: str, name: str, value: str, suffix: str = ".json") -> int:
    """One file per row, ``<path>/<folder>/doc-<quoted name><suffix>``, by the tasks themselves (a writer of partitions moves each file once
    more on the driver); how many. Names are distinct; ``readers.document_name`` reads them back. A task that runs again writes the same files."""
    folder = F.pmod(F.xxhash64(name), F.lit(FOLDERS)).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(path)
        made = set()
        for pdf in batches:
            for f, n, v in zip(pdf["f"], pdf["n"], pdf["v"]):
                if f not in made:
                    fs.create_dir(f"{root}/{f}", recursive=True)
                    made.add(f)
                with fs.open_output_stream(f"{root}/{f}/doc-{quote(n, safe='')}{suffix}") as out:
                    out.write(v.encode())
            yield pd.DataFrame({"written": [len(pdf)]})

    rows = df.select(folder.alias("f"), F.col(name).alias("n"), F.col(value).alias("v")).filter("n is not null and v is not null")
    return spread(rows, "f").mapInPandas(run, "written bigint").agg(F.sum("written")).first()[0] or 0


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").partitionBy(*partition_by).parquet(path)


def parquet_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> bool:
    """Writes a table unless a complete one is there; whether it wrote."""
    spark = df.sparkSession
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        return False
    parquet(df, path, partition_by)
    return True


def allocated(runs: DataFrame, day: str, label: str, name: str = "exp_id") -> DataFrame:
    """(run_id): the next id EXP-YYYYMMDD-NNN-label of a day (YYYYMMDD): the lowest number the runs leave free, not the highest plus one."""
    parts = F.split(name, "-")
    taken = runs.filter(F.col(name).rlike(rf"^EXP-{day}-\d+-")).select(F.lit(day).alias("day"), F.get(parts, F.lit(2)).cast("bigint").alias("c"))
    one = taken.sparkSession.createDataFrame([(day,)], "day string")
    free = one.join(first_gap(taken, ["day"], "c"), "day", "left").select(F.coalesce("next_free", F.lit(1)).alias("c"))
    return free.select(F.format_string("EXP-%s-%03d-%s", F.lit(day), F.col("c").cast("int"), F.lit(label)).alias("run_id"))


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A report table as text."""
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = _report(df).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(cell(r[c]) for c in df.columns) + " |\n" for r in rows)


def text_cards(df: DataFrame, path: str, template: str, columns: Sequence[str]) -> None:
    """One text per row from a template with %s places, in the given order of columns."""
    df.select(F.format_string(template, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value")).write.mode("overwrite").text(path)


def create_table(df_or_session, name: str, schema: str) -> None:
    """Creates an empty table if there is none."""
    session = getattr(df_or_session, "sparkSession", df_or_session)
    session.sql(f"create table if not exists {name} ({schema}) using parquet")


def run_ids(df: DataFrame, day: str, counter: str, label: str) -> DataFrame:
    """Adds run_id EXP-YYYYMMDD-NNN-label."""
    return df.withColumn("run_id", F.format_string("EXP-%s-%03d-%s", F.date_format(day, "yyyyMMdd"), F.col(counter).cast("int"), F.col(label)))
