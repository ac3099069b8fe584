"""Reading the two inputs and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_names, require_columns

OBSERVER_COLUMNS = ("haul_id", "trip_id", "drvid", "datatype")
FLEET_COLUMNS = ("drvid",)


def read_table(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = (),
    fmt: str = "parquet",
    schema: str | None = None,
    tidy_names: bool = False,
    **options: str,
) -> DataFrame:
    """A table with its columns checked up front; text formats need an explicit ``schema``.

    The check reads the footer only: missing columns fail before any job starts.
    """
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema: inference would read the whole table once more")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    df = clean_names(df) if tidy_names else df
    require_columns(df, required, path)
    return df


def read_observer(spark: SparkSession, path: str, required: Sequence[str] = OBSERVER_COLUMNS, **kw) -> DataFrame:
    """Observer catch records, sampled and unsampled alike."""
    return read_table(spark, path, required, **kw)


def read_fleet(spark: SparkSession, path: str, required: Sequence[str] = FLEET_COLUMNS, **kw) -> DataFrame:
    """Fleet landing lines."""
    return read_table(spark, path, required, **kw)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    """Write a result table; estimates are small, the writer keeps Spark's own partitions."""
    df.write.format(fmt).mode(mode).options(**options).save(path)


# Parts of a file, so that the tasks can cut a large value where they need to.
PARTS_PER_FILE = 256


def write_partitioned(
    df: DataFrame, path: str, column: str = "year", files_per_value: int = 1, mode: str = "errorifexists", **options: str
) -> None:
    """Write a table into one folder a value of ``column``, so that readers of one value open one folder.

    Rows are dealt out by range of the column and of a hash of the row: a task writes to few folders, and a value that is
    too large for one task, or is to have several files, is split. So what a task sorts does not grow with the table.
    """
    require_columns(df, [column], "table")
    if files_per_value < 1:
        raise ValueError("files_per_value must be positive")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_value * PARTS_PER_FILE))
    placed = df.withColumn("__part", part).repartitionByRange(column, "__part").drop("__part")
    placed.write.partitionBy(column).mode(mode).options(**options).parquet(path)
