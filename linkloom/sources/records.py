"""Readers and writers of source tables, truth tables and result files."""

from __future__ import annotations

import os
import zipfile

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from linkloom.functions import text

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
MATCH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_COLUMNS = ["source1_entity_id", "candidate_entity_ids"]
#: A text no field has, so that "NA" and "null" stay what they are.
_NO_NULL = "\x00none\x00"


def load_config(path: str) -> dict:
    """A YAML file as a dict, empty for an empty file."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        try:
            return yaml.safe_load(f) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"{path} is no valid YAML: {e}") from e


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str], usecols: list[str] | None = None, nrows: int | None = None) -> DataFrame:
    """A tab-separated table with header, all strings, a missing field as the empty string; the scan is pruned to usecols."""
    if missing := [c for c in usecols or [] if c not in columns]:
        raise ValueError(f"no such columns: {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, enforceSchema=False, nullValue=_NO_NULL, encoding="UTF-8")
    df = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in usecols or columns))
    return df if nrows is None else df.limit(nrows)


def read_source(spark: SparkSession, path: str | list[str], nrows: int | None = None, usecols: list[str] | None = None) -> DataFrame:
    return read_tsv(spark, path, SOURCE_COLUMNS, usecols, nrows)


def read_truth(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    return read_tsv(spark, path, TRUTH_COLUMNS, nrows=nrows)


def write_source(df: DataFrame, path: str) -> None:
    """A folder of tab-separated parts, each with header, that read_source reads back as it was; a null field is empty."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SOURCE_COLUMNS]
    df.select(fields).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def chunks(df: DataFrame, rows: int):
    """The rows of df as pandas frames of at most `rows` rows, a partition at a time on the driver."""
    import pandas as pd

    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def with_order(df: DataFrame) -> DataFrame:
    """df with `ord`, a number that ascends in scan order; stage it before using it twice."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def inspect_file(spark: SparkSession, path: str) -> dict:
    """Size, header and delimiter of a file, from its first line."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    size = fs.getFileStatus(hadoop).getLen()
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    delimiter = "\t" if "\t" in line else ","
    return {"path": path, "size_bytes": size, "size_mb": round(size / (1024 * 1024), 2), "header": line.split(delimiter), "delimiter": delimiter}


def write_partitioned(s1: DataFrame, targets: DataFrame, folder: str) -> None:
    """Both sides as Parquet by country key, so that a country's rows are a partition of the scan."""
    key = F.lower(F.trim("country"))
    for name, df in (("s1", s1), ("targets", targets)):
        df.withColumn("country_key", key).repartition("country_key", F.pmod(F.xxhash64("entity_id"), F.lit(32))).write.mode("overwrite").partitionBy("country_key").parquet(f"{folder}/{name}")


def read_country(spark: SparkSession, folder: str, side: str, countries: list[str] | None = None) -> DataFrame:
    """One side of write_partitioned, of some countries or all there are."""
    df = spark.read.parquet(f"{folder}/{side}")
    return df if countries is None else df.where(F.col("country_key").isin([c.strip().lower() for c in countries]))


def dedup_targets(targets: DataFrame, keep: str = "last") -> DataFrame:
    """One row per entity_id at its first position; its values are those of the first or the last row."""
    w = W.partitionBy("entity_id")
    order = F.desc("ord") if keep == "last" else F.asc("ord")
    ranked = targets.withColumns({"_n": F.row_number().over(w.orderBy(order)), "_at": F.min("ord").over(w)})
    return ranked.where("_n = 1").withColumn("ord", F.col("_at")).drop("_n", "_at")


def truth_sample(truth: DataFrame, entities: int) -> DataFrame:
    """The first `entities` distinct S1 ids of a truth table with ord, as (s1_id, matches)."""
    one = truth.groupBy(F.trim("source1_entity_id").alias("s1_id")).agg(F.min("ord").alias("ord"), F.min_by("matched_entity_ids", "ord").alias("ids"))
    return one.orderBy("ord").limit(entities).select("s1_id", "ord", text.parse_ids(F.col("ids")).alias("matches"))


def s1_of_truth(s1: DataFrame, truth: DataFrame, entities: int | None = None) -> DataFrame:
    """The S1 records that a truth sample names, in scan order."""
    kept = s1.join(truth.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    return kept if entities is None else kept.orderBy("ord").limit(entities)


def target_pool(targets: DataFrame, truth: DataFrame, pool: int, dedup: bool = True) -> DataFrame:
    """Every target that the truth needs and the first ones in scan order, up to `pool` before only needed ones are added.

    With dedup the first row of an id stands for all; without it, repeated ids are rows of their own.
    """
    needed = truth.select(F.explode("matches").alias("entity_id")).distinct().withColumn("needed", F.lit(True))
    first = dedup_targets(targets, "first") if dedup else targets
    early = first.orderBy("ord").limit(pool).select("ord").withColumn("early", F.lit(True))
    marked = first.join(needed, "entity_id", "left").join(early, "ord", "left").select(*first.columns, "needed", "early")
    return marked.where("needed or early").drop("needed", "early")


def _unquoted(c: Column) -> Column:
    """A field as a writer without quotes gives it: what would be read as more than text gets a backslash."""
    return F.regexp_replace(c, '([\\\\\t\n\r"])', r"\\$1")


def lines(results: DataFrame, id_column: str, list_column: str) -> DataFrame:
    """(ord, value): the line of each row; the list may be an array or a comma-joined string."""
    ids = F.col(list_column) if dict(results.dtypes)[list_column].startswith("array") else text.parse_ids(F.col(list_column))
    return results.select("ord", F.concat_ws("\t", _unquoted(F.trim(F.col(id_column).cast("string"))), _unquoted(text.format_ids(ids))).alias("value"))


def write_lines(rows: DataFrame, path: str, head: str) -> None:
    """One file: head, then the values of rows (ord, value) by ord; parts are sorted in parallel and appended in order."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = to.getFileSystem(conf)
    rows.orderBy("ord").select("value").write.mode("overwrite").text(parts.toString())
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}.tmp"), True)
    out.write(bytearray(f"{head}\n".encode()))
    for status in sorted((x for x in fs.listStatus(parts) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName()):
        stream = fs.open(status.getPath())
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        stream.close()
        # A part goes as soon as it is appended, or the file would take its place twice.
        fs.delete(status.getPath(), False)
    out.close()
    fs.delete(to, False)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.tmp"), to)
    fs.delete(parts, True)


def write_results(results: DataFrame, path: str, id_column: str, list_column: str) -> None:
    """One tab-separated file with header, rows by ord (if there), under path."""
    if not isinstance(results, DataFrame):
        raise TypeError(f"results must be a DataFrame, not {type(results).__name__}")
    if "ord" not in results.columns:
        results = with_order(results)
    write_lines(lines(results, id_column, list_column), path, f"{id_column}\t{list_column}")


def write_matching_results(results: DataFrame, path: str) -> None:
    write_results(results, path, *MATCH_COLUMNS)


def write_candidate_pairs(results: DataFrame, path: str) -> None:
    write_results(results, path, *CANDIDATE_COLUMNS)


def assemble(s1: DataFrame, results: DataFrame, list_column: str) -> DataFrame:
    """A row for every S1 record in its order; one without result has an empty list."""
    found = results.select(F.col("source1_entity_id").alias("_id"), F.col(list_column))
    joined = s1.select("entity_id", "ord").join(found, F.col("entity_id") == F.col("_id"), "left")
    return joined.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(list_column, F.array().cast("array<string>")).alias(list_column), "ord")


def package(paths: list[str], archive: str) -> None:
    """The files in one deflated archive, under their base names."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            z.write(p, os.path.basename(p))
