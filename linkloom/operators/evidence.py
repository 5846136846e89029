"""Evidence between the candidates of an S1 record: witnesses, triangles, relationships."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import text
from linkloom.sources.stages import staged

SUPPORT, NEUTRAL, CONTRADICTION = "support", "neutral", "contradiction"


def witness_score(a: Column, b: Column) -> Column:
    """Of two records as structs: edit similarity of names, with that of addresses where both are there."""
    name = text.edit_similarity(a["name_norm"], b["name_norm"])
    return F.when(~a["is_address_missing"] & ~b["is_address_missing"], 0.6 * name + 0.4 * text.edit_similarity(a["address_norm"], b["address_norm"])).otherwise(name)


def opposite_pairs(candidates: DataFrame, targets: DataFrame, compare: dict[str, Callable[[Column, Column], Column]], *values: str) -> DataFrame:
    """Each S2 candidate (a) with each S3 candidate (b) of the same S1 record: s1_id, both as structs of id, ord and values, and what `compare` says of both records.

    Alike S1 records have the same candidates: two targets are compared once, however many records have both, and only
    then do their texts go through a shuffle.
    """
    fields = ["name_norm", "address_norm", "is_address_missing", "country"]
    one = F.struct(F.col("target_id").alias("id"), "ord", *values)
    of = lambda source: F.collect_list(F.when(F.substring_index("target_id", "-", 1) == source, one))
    each = candidates.select("s1_id", "target_id", "ord", *values).repartition("s1_id").groupBy("s1_id").agg(of("S2").alias("a"), of("S3").alias("b"))
    pairs = staged(each.select("s1_id", F.explode("a").alias("a"), "b").select("s1_id", "a", F.explode("b").alias("b")), "opposite")
    record = lambda side: targets.select(F.col("entity_id").alias(f"{side}_id"), F.struct(*fields).alias(f"{side}_record"))
    # A comparison of long texts costs more than their bytes tell, so the number of tasks doesn't follow from these.
    tasks = 4 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).distinct().join(record("a"), "a_id").repartition(tasks, "b_id").join(record("b"), "b_id")
    said = once.select("a_id", "b_id", *(f(F.col("a_record"), F.col("b_record")).alias(k) for k, f in compare.items()))
    return pairs.withColumns({"a_id": F.col("a.id"), "b_id": F.col("b.id")}).join(said, ["a_id", "b_id"]).select("s1_id", "a", "b", *compare)


def strongest_witness(candidates: DataFrame, targets: DataFrame, min_score: float = 0.70) -> DataFrame:
    """candidates' pairs with witness_id and witness_score: the best candidate of the other source; null and 0 below min_score."""
    scored = opposite_pairs(candidates, targets, {"w": witness_score})
    # The score is the same both ways; each pair is a witness for both.
    way = lambda x, y: F.struct(x["id"].alias("target_id"), y["id"].alias("other_id"), y["ord"].alias("other_ord"))
    a, b = F.col("a"), F.col("b")
    both = scored.select("s1_id", "w", F.explode(F.array(way(a, b), way(b, a))).alias("p")).select("s1_id", "w", "p.*")
    best = both.withColumn("_n", F.row_number().over(W.partitionBy("s1_id", "target_id").orderBy(F.desc("w"), "other_ord"))).where("_n = 1")
    best = best.where(F.col("w") >= min_score).select("s1_id", "target_id", "other_id", "w")
    return candidates.select("s1_id", "target_id").join(best, ["s1_id", "target_id"], "left").select("s1_id", "target_id", F.col("other_id").alias("witness_id"), F.coalesce("w", F.lit(0.0)).alias("witness_score"))


def triangle_support(a: Column, b: Column, c: Column, threshold: float = 0.65) -> dict[str, Column]:
    """Of a triangle's three edges: closed if all reach the threshold, the weakest and the mean edge."""
    least = F.least(a, b, c)
    return {"is_closed": least >= threshold, "min_edge": least, "mean_edge": (a + b + c) / 3.0}


def triangles(scored: DataFrame, targets: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Triangles of an S1 record, one S2 and one S3 candidate; edges are their scores and the witness score."""
    a, b = F.col("a"), F.col("b")
    edges = opposite_pairs(scored, targets, {"w": witness_score}, "score")
    support = triangle_support(a["score"], b["score"], F.col("w"), threshold)
    return edges.select("s1_id", a["id"].alias("s2_id"), b["id"].alias("s3_id"), *(c.alias(k) for k, c in support.items()))


def relationship(a: Column, b: Column, support: float = 0.85, contradiction: float = 0.30) -> Column:
    """Of two records as structs: country conflict, then unlike names at given addresses, then like names."""
    conflict = (a["country"] != "") & (b["country"] != "") & (a["country"] != b["country"])
    name = text.edit_similarity(a["name_norm"], b["name_norm"])
    unlike = ~a["is_address_missing"] & ~b["is_address_missing"] & (name < contradiction)
    return F.when(conflict | unlike, CONTRADICTION).when(name >= support, SUPPORT).otherwise(NEUTRAL)


def relationships(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """The relationship of each S2 candidate with each S3 candidate of the same S1 record."""
    found = opposite_pairs(candidates, targets, {"relationship": relationship})
    return found.select("s1_id", F.col("a.id").alias("s2_id"), F.col("b.id").alias("s3_id"), "relationship")
