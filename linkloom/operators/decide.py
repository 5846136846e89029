"""Decisions per S1 record over its scored candidates (s1_id, target_id, score, route_rank, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _rank() -> Column:
    """The place of a candidate: by score, then route, then scan order."""
    return F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc("score"), "route_rank", "ord"))


def scored_matches(scored: DataFrame, threshold: float = 0.5, max_matches: int = 15, margin_threshold: float = 0.05, ambiguity_penalty: bool = True) -> DataFrame:
    """scored with rank and is_accepted.

    The best candidate is taken before the cap is first looked at, so a cap of 1 lets two through.  The
    margin and the penalty are accepted and have no effect, as in the baseline.
    """
    ranked = scored.withColumn("rank", _rank())
    return ranked.withColumn("is_accepted", (F.col("score") >= threshold) & (F.col("rank") <= max(max_matches, 2)))


def decide(scored: DataFrame, threshold: float = 0.5, max_matches: int = 15, **ignored) -> DataFrame:
    """Accepted pairs with their rank."""
    return scored_matches(scored, threshold, max_matches, **ignored).where("is_accepted").drop("is_accepted")


def decide_all(scored: DataFrame, s1: DataFrame, threshold: float = 0.5, max_matches: int = 15) -> DataFrame:
    """A row for every S1 record: source1_entity_id, matched_entity_ids (array, best first, maybe empty), ord."""
    return listed(decide(scored, threshold, max_matches), s1)


def listed(accepted: DataFrame, s1: DataFrame) -> DataFrame:
    """decide_all from accepted pairs with their rank."""
    lists = accepted.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id"))), lambda x: x["target_id"]).alias("ids"))
    every = s1.select(F.col("entity_id").alias("s1_id"), "ord").join(lists, "s1_id", "left")
    return every.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.array().cast("array<string>")).alias("matched_entity_ids"), "ord")


def top_margin(scored: DataFrame) -> DataFrame:
    """Per S1 id with candidates: their number, the best score and its lead over the next (1 if there is none)."""
    top = scored.withColumn("rank", _rank())
    agg = top.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return agg.select("s1_id", "n", "top_score", F.when(F.col("n") == 1, 1.0).otherwise(F.col("top_score") - F.col("second")).alias("margin"))


def listed_margin(lists: DataFrame) -> DataFrame:
    """top_margin of rows of s1 and an array of scores, some for each s1: only the best two of a row are shuffled."""
    best = F.slice(F.sort_array("score", asc=False), 1, 2)
    agg = lists.select("s1", F.size("score").cast("long").alias("n"), best.alias("best")).groupBy("s1").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("best")), asc=False).alias("best"))
    top = agg.select("s1", "n", F.col("best")[0].alias("top_score"), F.get("best", F.lit(1)).alias("second"))
    return top.select("s1", "n", "top_score", F.when(F.col("n") == 1, 1.0).otherwise(F.col("top_score") - F.col("second")).alias("margin"))


def flagged(margins: DataFrame, margin_threshold: float = 0.03, score_threshold: float = 0.60) -> DataFrame:
    """top_margin with is_ambiguous: two candidates or more, a good best one and a small lead."""
    flag = (F.col("n") >= 2) & (F.col("top_score") >= score_threshold) & (F.col("margin") < margin_threshold)
    return margins.withColumn("is_ambiguous", flag)


def ambiguous(scored: DataFrame, margin_threshold: float = 0.03, score_threshold: float = 0.60) -> DataFrame:
    return flagged(top_margin(scored), margin_threshold, score_threshold)


def source_thresholds(scored: DataFrame, s2_threshold: float = 0.5, s3_threshold: float = 0.5) -> DataFrame:
    """Candidates that reach the threshold of their source; other sources have the lower one."""
    t = F.when(F.col("target_id").startswith("S2-"), s2_threshold).when(F.col("target_id").startswith("S3-"), s3_threshold).otherwise(min(s2_threshold, s3_threshold))
    return scored.where(F.col("score") >= t)
