"""Shared pieces: written stages, ranks without a single hot window, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word of the contracts: a run without space and without U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: with texts of 100 KB a batch still stays near 50 MB.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lowers the rows of an Arrow batch, so that a batch of long texts fits in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and all is one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/linkloom/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps need no earlier shuffle files.

    Unlike checkpoint() the table is columnar and compressed, and is computed once.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(df: DataFrame, *columns: str) -> DataFrame:
    """df as (h1, h2, d): 128 bits that name a row by some of its columns, nulls told apart, and its columns, which can't clash with ours.

    Ids may be null or repeat, and a number given by Spark would need the whole table written to stay fixed.
    """
    own = [F.col(f"`{c}`") for c in columns]
    own += [c.isNull() for c in own]
    return df.select(F.xxhash64(F.lit(1), *own).alias("h1"), F.xxhash64(F.lit(2), *own).alias("h2"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("d"))


def summed(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str, rows: int, part_rows: int = 1_000_000) -> DataFrame:
    """df, staged in the order of a global range sort, with a running sum (from the first row to this one) for each of `sums`.

    The rows are range-partitioned by `order`, so that a partition holds about part_rows of them however
    they are distributed, and for each the table tells which one it was laid in, for Spark may have made
    more or fewer.  Sums of whole partitions (a row each) go before the sums inside.
    """
    parts, part = max(1, -(-rows // part_rows)), f"__{name}_part"
    laid = stage(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), name)
    inside = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    whole = laid.groupBy(part).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    firsts = whole.select(part, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}_first") for n in sums))
    out = laid.join(F.broadcast(firsts), part).withColumns({n: F.col(f"__{n}_first") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.drop(part, *(f"__{n}_first" for n in sums))


def drop_stages(spark: SparkSession) -> None:
    """Removes the tables that this application staged; call it when their results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str, bucket: Column | None = None, buckets: int = 1024, rows: DataFrame | None = None) -> DataFrame:
    """Adds `name`: a gapless rank from 0 within `by`, though a value of `by` may hold most rows.

    Rows fall into `buckets` by `bucket` (a hash of the order columns if none is given; order between
    buckets is by their number).  A rank is the size of all earlier buckets plus the rank in the own
    one, so that no window holds more than a bucket.  df is read twice: give a staged one, or `rows` to
    count the buckets by, the same rows without what is heavy.  The columns of `by` must not be null.
    """
    b, first = f"__{name}_b", f"__{name}_first"
    bucket = bucket if bucket is not None else F.pmod(F.xxhash64(*order), F.lit(buckets))
    df = df.withColumn(b, bucket)
    sizes = (df if rows is None else rows.withColumn(b, bucket)).groupBy(*by, b).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.select(*by, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(first))
    inside = F.row_number().over(W.partitionBy(*by, b).orderBy(*order)) - 1
    return df.join(firsts, [*by, b]).withColumn(name, F.col(first) + inside).drop(b, first)


def lookup(rows: DataFrame, values: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows left join values on key (unique in values), where any key may hold most rows.

    Keys with at least 1/share of all rows are fewer than `share`, whatever the size of the data: their
    values are broadcast.  All other keys go through a shuffle join.  Null keys get no value.  Both
    inputs are read twice: give staged ones.
    """
    total = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * share > total)
    hot = [r[0] for r in hot.select(key).collect()]  # fewer than `share` keys
    if not hot:
        return rows.join(values, key, "left")
    frequent = F.col(key).isin(hot)
    cold = F.coalesce(~frequent, F.lit(True))
    return rows.where(frequent).join(F.broadcast(values.where(frequent)), key, "left").unionByName(rows.where(cold).join(values.where(cold), key, "left"))
