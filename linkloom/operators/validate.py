"""Checks of result files, as tables of findings (severity, rule, n, examples).

Files are read as lines, so that malformed ones are seen as they are.  Two rule sets: the pipeline's own
invariants, and the stricter reading of the receiver, which trims nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import text
from linkloom.sources.records import CANDIDATE_COLUMNS, MATCH_COLUMNS

EXAMPLES = 5


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def header(spark: SparkSession, path: str) -> str | None:
    row = spark.read.option("lineSep", "\n").text(path).first()
    return None if row is None else row[0]


def body(spark: SparkSession, path: str, head: str) -> DataFrame:
    """Lines after the header; a line like the header anywhere else is dropped with it only if it is the first of the file."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")))
    return lines.where((F.col("value") != head) | (F.col("_at.n") > 0)).select("value")


def _findings(parts: list[tuple[str, str, DataFrame]], spark: SparkSession) -> DataFrame:
    """A row per violated rule; each part is (severity, rule, offenders: one column)."""
    rows = [df.select(F.lit(s).alias("severity"), F.lit(r).alias("rule"), F.col(df.columns[0]).cast("string").alias("example")) for s, r, df in parts]
    if not rows:
        return spark.createDataFrame([], "severity string, rule string, n long, examples array<string>")
    every = reduce(DataFrame.unionAll, rows)
    # The least examples of a rule are kept by a sum that holds EXAMPLES values, not all offenders.
    counted = every.groupBy("severity", "rule", "example").agg(F.count(F.lit(1)).alias("_c"))
    nth = F.row_number().over(W.partitionBy("severity", "rule").orderBy("example"))
    first = counted.withColumn("_n", nth).where(F.col("_n") <= EXAMPLES).groupBy("severity", "rule").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return counted.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n")).join(first, ["severity", "rule"])


def _parsed(lines: DataFrame, trim: bool) -> DataFrame:
    """s1, ids (array) and whether the line has two fields."""
    clean = F.regexp_replace("value", r"\r$", "") if trim else F.col("value")
    parts = F.split(clean, "\t", -1)
    if trim:
        return lines.select("value", (F.size(parts) == 2).alias("ok"), F.trim(parts[0]).alias("s1"), text.parse_ids(F.get(parts, F.lit(1))).alias("ids"))
    rest = F.regexp_replace(clean, r"^[^\t]*\t?", "")
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",", -1))
    return lines.select("value", F.col("value").contains("\t").alias("ok"), parts[0].alias("s1"), ids.alias("ids"))


def _list_rules(rows: DataFrame, what: str) -> list[tuple[str, str, DataFrame]]:
    """Rules on the rows of one file."""
    good = rows.where("ok")
    each = good.select("s1", F.explode("ids").alias("id"))
    plain = ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")
    return [
        ("error", f"{what}: duplicate S1 row", good.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s1")),
        ("error", f"{what}: repeated id in a list", good.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1")),
        ("error", f"{what}: self match", each.where(F.col("id").startswith("S1-")).select("id")),
        ("error", f"{what}: wrong prefix", each.where(plain & ~F.col("id").startswith("S1-")).select("id")),
    ]


def _coverage(rows: DataFrame, required: DataFrame, what: str) -> list[tuple[str, str, DataFrame]]:
    seen = rows.where("ok").select("s1").distinct()
    need = required.select("s1").distinct()
    return [("error", f"{what}: required S1 id missing", need.join(seen, "s1", "left_anti")), ("error", f"{what}: S1 id not required", seen.join(need, "s1", "left_anti"))]


def _uncovered(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """S1 ids with matches that are no candidates; the lists of repeated rows are joined."""
    c = candidates.where("ok").groupBy("s1").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("c"))
    m = matching.where("ok").select("s1", "ids").join(c, "s1", "left")
    return m.where(F.size(F.array_except("ids", F.coalesce("c", F.array().cast("array<string>")))) > 0).select("s1").distinct()


def verify_invariants(spark: SparkSession, matching_path: str, candidate_path: str | None = None, source1_path: str | None = None) -> tuple[bool, DataFrame]:
    """(valid, findings) of the pipeline's own rules; a match that is no candidate is an error."""
    one = lambda s: spark.range(1).select(F.lit(s).alias("x"))
    if not exists(spark, matching_path):
        found = _findings([("error", "matching: file not found", one(matching_path))], spark)
        return False, found
    parts = []
    head = header(spark, matching_path) or ""
    if head.rstrip("\r").split("\t") != MATCH_COLUMNS:
        parts.append(("error", "matching: invalid header", one(head)))
    rows = _parsed(body(spark, matching_path, head), True)
    parts += [("error", "matching: malformed row", rows.where("not ok").select("value")), *_list_rules(rows, "matching")]
    if candidate_path is not None:
        if not exists(spark, candidate_path):
            parts.append(("error", "candidates: file not found", one(candidate_path)))
        else:
            c_head = header(spark, candidate_path) or ""
            if c_head.rstrip("\r").split("\t") != CANDIDATE_COLUMNS:
                parts.append(("error", "candidates: invalid header", one(c_head)))
            c = _parsed(body(spark, candidate_path, c_head), True)
            parts += [("error", "candidates: malformed row", c.where("not ok").select("value")), _list_rules(c, "candidates")[0], ("error", "matching: match is no candidate", _uncovered(rows, c))]
    if source1_path is not None and exists(spark, source1_path):
        parts += _coverage(rows, _required(spark, source1_path, blank=True), "matching")
    found = _findings(parts, spark)
    return found.where("severity = 'error'").limit(1).count() == 0, found


def _required(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    rows = body(spark, path, header(spark, path) or "").select(F.trim(F.split("value", "\t", 2)[0]).alias("s1"), "value")
    return rows.select("s1") if blank else rows.where(F.trim("value") != "").select("s1")


def validate(spark: SparkSession, matching_path: str, candidate_path: str | None, test_dir: str, check_ids: bool = False) -> DataFrame:
    """Findings of the receiver's rules; a match that is no candidate is a warning."""
    one = lambda s: spark.range(1).select(F.lit(s).alias("x"))
    source1 = f"{test_dir}/test_source1.tsv"
    if not exists(spark, source1):
        return _findings([("error", "source 1 file not found", one(source1))], spark)
    required = _required(spark, source1)
    parts: list = []
    known = None
    if not check_ids:
        parts.append(("warning", "existence of ids is not checked", one("check_ids")))
    else:
        files = [f"{test_dir}/test_source{n}.tsv" for n in (2, 3)]
        absent = [f for f in files if not exists(spark, f)]
        if absent:
            parts.append(("warning", "target file not found, existence of ids is not checked", one(absent[0])))
        else:
            known = reduce(DataFrame.unionAll, (_required(spark, f) for f in files)).distinct()

    def file(path: str, columns: list[str], what: str) -> DataFrame | None:
        if not exists(spark, path):
            parts.append(("error", f"{what}: file not found", one(path)))
            return None
        head = header(spark, path)
        if not head:
            parts.append(("error", f"{what}: file is empty", one(path)))
            return None
        if "\t" not in head and "," in head:
            parts.append(("error", f"{what}: file is separated by commas", one(head)))
            return None
        if [c.strip().lower() for c in head.split("\t")] != columns:
            parts.append(("error", f"{what}: unexpected header", one(head)))
            return None
        rows = _parsed(body(spark, path, head), False)
        parts.append(("error", f"{what}: malformed row", rows.where("not ok").where(F.trim("value") != "").select("value")))
        parts.extend(_list_rules(rows, what))
        if known is not None:
            each = rows.where("ok").select(F.explode("ids").alias("s1")).where(F.col("s1").startswith("S2-") | F.col("s1").startswith("S3-")).distinct()
            parts.append(("error", f"{what}: unknown id", each.join(known, "s1", "left_anti")))
        parts.extend(_coverage(rows, required, what))
        return rows

    matching = file(matching_path, MATCH_COLUMNS, "matching")
    candidates = None
    if candidate_path and exists(spark, candidate_path):
        candidates = file(candidate_path, CANDIDATE_COLUMNS, "candidates")
    elif candidate_path:
        parts.append(("warning", "candidates: file not found", one(candidate_path)))
    if matching is not None and candidates is not None:
        parts.append(("warning", "matching: match is no candidate", _uncovered(matching, candidates)))
    return _findings(parts, spark)


def violations(results: DataFrame, candidates: DataFrame, required: DataFrame) -> DataFrame:
    """The same rules over tables: results and candidates (s1, ids array), required (s1); (rule, n) with zeros left out."""
    r, c = results.withColumn("ok", F.lit(True)), candidates.withColumn("ok", F.lit(True))
    parts = [*_list_rules(r, "matching"), *_list_rules(c, "candidates"), *_coverage(r, required, "matching"), ("error", "matching: match is no candidate", _uncovered(r, c))]
    return _findings(parts, results.sparkSession).select("rule", "n")


def passes(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").limit(1).count() == 0
