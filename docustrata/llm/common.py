"""What the operators of this subpackage share: shared-folder tables, ordered offsets, small column helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docustrata.session import checkpoint_dir, drop_path, scratch_path

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the shared folder, without lineage. For narrow rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """The rows, checkpointed, and how many of them fulfil `what` (all of them if not named), counted while they are written."""
    seen = Observation()
    rows = checkpointed(df.observe(seen, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")))
    return rows, int(seen.get["n"])


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder, without lineage. For wide rows."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a table that written() made, when nothing will read it any more."""
    drop_path(table.sparkSession, table._scratch)


def free_name(df: DataFrame, base: str, *others: str) -> str:
    """A column name that no column of df has, nor is among the others, in any case."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while base.lower() in taken:
        base += "_"
    return base


def fresh_names(df: DataFrame, *names: str) -> None:
    """Raises if df has a column of one of these names, in any case: an operator's own columns would hide it or be hidden."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns named as results: {', '.join(sorted(taken))}; rename them or give the results other names")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def salted(rows: DataFrame, of: DataFrame, key: str, by: list[str], salts: int = 16) -> DataFrame:
    """rows with the columns of `of` (one row for each key at most), null where it has none. Rows of one key are dealt to
    `salts` parts by a hash of the columns `by`, so that a key with a great share of the rows is no single task's. The join
    is by sorting: what `of` grows to is not in the statistics that a broadcast would be chosen by."""
    salt = free_name(rows, "salt", *of.columns)
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt)
    return rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(of.select("*", each).hint("merge"), [key, salt], "left").drop(salt)


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def ordered(df: DataFrame, keys: list[str], size: str, group: str | None = None) -> DataFrame:
    """Adds row (long, from 0, ascending by keys) and start (long, sum of size over
    the rows before, of the same group if one is named). group must lead keys.

    Rows are range-partitioned by keys and sorted; each partition numbers its own
    rows; the totals of the partitions, a row for each partition and group it
    holds, are summed by a window and broadcast back. The numbered rows are
    checkpointed, so that a lost executor can't number them anew.
    """
    part, local, before = "__part", "__local", "__before"
    group_col = group or "__all"
    src = df if group else df.withColumn("__all", F.lit(0))
    schema = T.StructType([*src.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(local, T.LongType()), T.StructField(before, T.LongType())])

    at, by = src.columns.index(size), src.columns.index(group_col)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen, sums = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            n = batch.num_rows
            sizes, g = pd.Series(batch.column(at).to_numpy(zero_copy_only=False).astype("int64")), pd.Series(batch.column(by).to_numpy(zero_copy_only=False))
            before_each = sizes.groupby(g).cumsum() - sizes + g.map(sums).fillna(0).astype("int64")
            for k, v in sizes.groupby(g).sum().items():
                sums[k] = sums.get(k, 0) + int(v)
            more = [pa.array([pid] * n, pa.int32()), pa.array(range(seen, seen + n), pa.int64()), pa.array(before_each.to_numpy("int64"))]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, part, local, before])

    rows = checkpointed(src.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema))
    totals = rows.groupBy(part, group_col).agg(F.sum(size).alias("__t"), F.count("*").alias("__n"))
    totals = totals.withColumn("start0", F.coalesce(F.sum("__t").over(Window.partitionBy(group_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = totals.groupBy(part).agg(F.sum("__n").alias("__n"))
    counts = counts.select(part, F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("row0"))
    totals = checkpointed(totals.join(counts, part).select(part, group_col, "start0", "row0"))
    out = rows.join(F.broadcast(totals), [part, group_col])
    return out.select(*df.columns, (F.col("row0") + F.col(local)).alias("row"), (F.col("start0") + F.col(before)).alias("start"))
