"""What the text operators share: tables, words, spans, stored intermediate results."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one under the warehouse where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no recomputation.

    The tables lie in a folder named after the application; whoever ends the application removes it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``df`` stored like ``stored``, but as a table bucketed by ``keys``: joins on them do not move it again."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}"
    df.write.bucketBy(buckets, *keys).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def boxed(docs: DataFrame) -> DataFrame:
    """(row, key_id, key_hash): whole rows in one column, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key_id"), F.xxhash64(text_of()).alias("key_hash"))


def same_document(id_column: str = "doc_id", hash_column: str = "text_hash") -> Column:
    """Joins ``boxed`` rows with rows that name a document by id and hash of its text."""
    return F.col("key_id").eqNullSafe(F.col(id_column)) & (F.col("key_hash") == F.col(hash_column))


def numbered(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """``df`` with a row number from 1 in the given order, without sorting everything in one task.

    Rows are dealt out by range and stored; each range is numbered by itself and shifted by the counts
    of the ranges before it (one row for each range).
    """
    placed = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_own", own).join(shift, "_range").withColumn(column, F.col("_own") + F.col("_shift")).drop("_range", "_own", "_shift")


def match_spans(text: Column, pattern: str, extra: int | None = None) -> Column:
    """All leftmost non-overlapping matches as (start, end, match[, group]), in code points, end exclusive.

    The pieces between the matches and the matches themselves come from the same search, so their lengths
    add up to the positions. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(extra)) if extra else found
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string,part:string>>").alias("out"))

    def add(gap_lengths, ms, parts):
        def step(acc, i):
            start = acc["at"] + gap_lengths[i]
            end = start + F.char_length(ms[i])
            item = F.struct(start.alias("start"), end.alias("end"), ms[i].alias("match"), parts[i].alias("part"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], item).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(ms) - 1), zero, step, lambda acc: acc["out"])

    lengths = F.transform(gaps, lambda g: F.char_length(g))
    body = let(found, lambda ms: let(lengths, lambda gl: let(group, lambda ps: F.when(F.size(ms) > 0, add(gl, ms, ps)).otherwise(zero["out"]))))
    return F.when(text.rlike(pattern), body).otherwise(zero["out"])


def whole_groups(batches, keys: list[str]):
    """Arrow tables of whole groups from batches sorted by ``keys``; holds back only the last, open group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for key in keys:
            values = table[key].to_numpy()
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield table.slice(0, cuts[-1] + 1)
            table = table.slice(cuts[-1] + 1)
        held = table
    if held is not None:
        yield held


class Forest:
    """Union-find over the rows of one table in a task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins pairs of rows; which of the pairs joined two trees."""
        label, used = self.label, np.zeros(len(a), dtype=bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            while label[x] != x:
                label[x] = x = label[label[x]]
            while label[y] != y:
                label[y] = y = label[label[y]]
            if x != y:
                label[max(x, y)] = min(x, y)
                used[k] = True
        while True:
            up = label[label]
            if np.array_equal(up, label):
                return used
            label[:] = up
