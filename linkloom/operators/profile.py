"""Profiles of source and truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import text

#: Rows, in scan order, over which frequent values are counted.
FREQUENT_ROWS = 500_000
TOP = 5


def _pct(part, whole, digits: int = 3):
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def source(df: DataFrame) -> DataFrame:
    """One row about a source table (raw columns): counts, shares and mean lengths."""
    c = {k: F.trim(F.coalesce(k, F.lit(""))) for k in ("entity_id", "business_name", "business_address", "country")}
    count = lambda x: F.count(F.when(x, 1))
    total = F.count(F.lit(1))
    mean = lambda k: F.coalesce(F.round(F.avg(F.when(c[k] != "", F.length(c[k]))), 2), F.lit(0.0))
    return df.agg(
        total.alias("total_rows"),
        count(c["business_name"] == "").alias("missing_names"),
        count(c["business_address"] == "").alias("missing_addrs"),
        _pct(count(c["business_address"] == ""), total).alias("missing_addrs_pct"),
        count(c["country"] == "").alias("empty_countries"),
        count(~c["entity_id"].rlike("^S[123]-")).alias("malformed_ids"),
        mean("business_name").alias("avg_name_length"),
        mean("business_address").alias("avg_addr_length"),
    )


def countries(df: DataFrame) -> DataFrame:
    """(country, n) of non-empty countries."""
    return df.select(F.trim("country").alias("country")).where("country <> ''").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def frequent(df: DataFrame, rows: int | None = FREQUENT_ROWS, top: int = TOP) -> DataFrame:
    """(what, value, n): the most frequent names, addresses and tokens of three characters or more among the first rows, or all if rows is None; ties by first occurrence."""
    early = df if rows is None else df.orderBy("ord").limit(rows)
    name, addr = text.business_name(F.trim("business_name")), text.address(F.trim("business_address"))
    n = early.select("ord", F.when(F.trim("business_name") != "", name).alias("name"), F.when(F.trim("business_address") != "", addr).alias("addr"))
    words = F.filter(text.tokens(F.col("name")), lambda t: F.length(t) >= 3)
    values = F.array(F.struct(F.lit("name").alias("what"), F.col("name").alias("value"), F.lit(0).alias("at")), F.struct(F.lit("addr").alias("what"), F.col("addr").alias("value"), F.lit(0).alias("at")))
    tokens = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda t, i: F.struct(F.lit("token").alias("what"), t.alias("value"), i.alias("at")))
    long = n.select("ord", F.explode(F.concat(values, tokens)).alias("v")).where("v.value is not null").groupBy("v.what", "v.value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "v.at")).alias("first"))
    w = W.partitionBy("what").orderBy(F.desc("n"), "first")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("what", "value", "n", "rank")


def truth(df: DataFrame) -> DataFrame:
    """One row about a truth table (source1_entity_id, matched_entity_ids)."""
    ids = text.parse_ids(F.col("matched_entity_ids"))
    has = lambda p: F.exists("ids", lambda x: x.startswith(p))
    k, s2, s3 = F.size("ids"), has("S2-"), has("S3-")
    count = lambda x: F.count(F.when(x, 1))
    total = F.count(F.lit(1))
    return df.select(ids.alias("ids")).agg(
        total.alias("total_s1"),
        count(k == 0).alias("zero_matches"),
        _pct(count(k == 0), total).alias("zero_matches_pct"),
        count(k == 1).alias("one_match"),
        _pct(count(k == 1), total).alias("one_match_pct"),
        count(k > 1).alias("multi_match"),
        _pct(count(k > 1), total).alias("multi_match_pct"),
        count(s2 & ~s3).alias("s2_only"),
        count(s3 & ~s2).alias("s3_only"),
        count(s2 & s3).alias("both_sources"),
        F.coalesce(F.sum(k), F.lit(0)).cast("long").alias("total_true_links"),
        F.coalesce(F.round(F.avg(k), 3), F.lit(0.0)).alias("avg_matches_per_s1"),
        F.coalesce(F.max(k), F.lit(0)).alias("max_matches_seen"),
    )


def cardinalities(df: DataFrame) -> DataFrame:
    """(matches, n): how many S1 rows list so many ids."""
    return df.groupBy(F.size(text.parse_ids(F.col("matched_entity_ids"))).alias("matches")).agg(F.count(F.lit(1)).alias("n"))
