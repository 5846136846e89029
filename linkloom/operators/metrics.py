"""Metrics over pairs: truth and predictions are DataFrames of (s1_id, target_id), entities of s1_id.

Entities are those of the truth table, with and without matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The cohorts of a report, which overlap.
COHORTS = ["all", "singletons", "one_match", "multi_match", "s2_only", "s3_only", "both_sources"]


def precision(n_pred: str, n_true: str, n_hit: str) -> Column:
    p, t, h = F.col(n_pred), F.col(n_true), F.col(n_hit)
    return F.when(t == 0, F.when(p == 0, 1.0).otherwise(0.0)).when(p == 0, 0.0).otherwise(h / p)


def recall(n_pred: str, n_true: str, n_hit: str) -> Column:
    p, t, h = F.col(n_pred), F.col(n_true), F.col(n_hit)
    return F.when(t == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(h / t)


def f05(n_pred: str, n_true: str, n_hit: str) -> Column:
    """Precision weighs more than recall; an entity without matches is right if nothing is predicted."""
    p, r = precision(n_pred, n_true, n_hit), recall(n_pred, n_true, n_hit)
    return F.when(p + r > 0, 1.25 * p * r / F.when(p + r > 0, 0.25 * p + r)).otherwise(0.0)


def _clean(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.trim("s1_id").alias("s1_id"), F.trim("target_id").alias("target_id")).where("target_id <> ''")


def per_entity(predictions: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """s1_id, n_pred, n_true, n_hit (distinct ids), n_listed and n_true_listed (as listed), precision, recall, f05."""
    p = _clean(predictions).groupBy("s1_id", "target_id").agg(F.count(F.lit(1)).alias("np"))
    t = _clean(truth).groupBy("s1_id", "target_id").agg(F.count(F.lit(1)).alias("nt"))
    both = p.join(t, ["s1_id", "target_id"], "full")
    has2, has3 = (F.max(F.when(F.col("nt").isNotNull(), F.col("target_id").startswith(x).cast("int"))) for x in ("S2-", "S3-"))
    counts = both.groupBy("s1_id").agg(F.count("np").alias("n_pred"), F.count("nt").alias("n_true"), F.count(F.when(F.col("np").isNotNull() & F.col("nt").isNotNull(), 1)).alias("n_hit"), F.sum("np").alias("n_listed"), F.sum("nt").alias("n_true_listed"), has2.alias("s2"), has3.alias("s3"))
    return of_counts(entities.select("s1_id").distinct().join(counts, "s1_id", "left"))


def of_counts(counts: DataFrame) -> DataFrame:
    """A row per entity with its counts (null: 0), as per_entity gives it."""
    every = counts.fillna(0, ["n_pred", "n_true", "n_hit", "n_listed", "n_true_listed", "s2", "s3"])
    args = ("n_pred", "n_true", "n_hit")
    return every.withColumns({"precision": precision(*args), "recall": recall(*args), "f05": f05(*args)})


def macro_f05(predictions: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row, 0 without entities."""
    return per_entity(predictions, truth, entities).agg(F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f0_5"))


def evaluate(predictions: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: macro_f0_5, mean_precision, mean_recall, singleton_accuracy (1 without singletons), total_entities."""
    return evaluate_each(per_entity(predictions, truth, entities))


def evaluate_each(each: DataFrame) -> DataFrame:
    """evaluate from the rows of per_entity."""
    idle = F.col("n_true_listed") == 0
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.agg(mean("f05").alias("macro_f0_5"), mean("precision").alias("mean_precision"), mean("recall").alias("mean_recall"), F.coalesce(F.avg(F.when(idle, (F.col("n_listed") == 0).cast("double"))), F.lit(1.0)).alias("singleton_accuracy"), F.count(F.lit(1)).alias("total_entities"))


def cohorts(predictions: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """A row per cohort, zeros for an empty one; cardinality counts ids as listed."""
    return cohorts_each(per_entity(predictions, truth, entities))


def cohorts_each(each: DataFrame) -> DataFrame:
    """cohorts from the rows of per_entity."""
    n, s2, s3 = F.col("n_true_listed"), F.col("s2") == 1, F.col("s3") == 1
    labels = F.array(
        F.lit("all"),
        F.when(n == 0, "singletons").when(n == 1, "one_match").otherwise("multi_match"),
        F.when(s2 & ~s3, "s2_only").when(s3 & ~s2, "s3_only").when(s2 & s3, "both_sources"),
    )
    sums = each.select(F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("cohort"), "f05", "precision", "recall").groupBy("cohort").agg(F.count(F.lit(1)).alias("count"), F.avg("f05").alias("macro_f0_5"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"))
    names = each.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, COHORTS))).alias("cohort"))
    values = ["count", "macro_f0_5", "mean_precision", "mean_recall"]
    return names.join(F.broadcast(sums), "cohort", "left").select("cohort", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values))


def candidate_recall(candidates: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: recall (1 without truth), covered and total true pairs, candidate pairs and their mean per entity."""
    return recall_each(per_entity(candidates, truth, entities))


def recall_each(each: DataFrame) -> DataFrame:
    """candidate_recall from the rows of per_entity."""
    sums = each.agg(F.coalesce(F.sum("n_hit"), F.lit(0)).alias("covered_matches"), F.coalesce(F.sum("n_true"), F.lit(0)).alias("total_true_matches"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("total_candidate_pairs"), F.count(F.lit(1)).alias("_n"))
    return sums.select(F.when(F.col("total_true_matches") > 0, F.col("covered_matches") / F.col("total_true_matches")).otherwise(1.0).alias("candidate_recall"), "covered_matches", "total_true_matches", "total_candidate_pairs", F.when(F.col("_n") > 0, F.col("total_candidate_pairs") / F.col("_n")).otherwise(0.0).alias("avg_candidates_per_s1"))


def blocking_stats(candidates: DataFrame, truth: DataFrame, s1: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """One row about a route or a union of routes: recall, candidates per S1 record and how much of all pairs is left out."""
    entities = s1.select(F.col("entity_id").alias("s1_id")).distinct()
    each = per_entity(candidates.select("s1_id", "target_id").distinct(), truth, entities)
    return stats_each(each.withColumn("blocker", F.lit(name)), targets)


def stats_each(each: DataFrame, targets: DataFrame) -> DataFrame:
    """blocking_stats of every blocker, from rows of per_entity with its name as blocker."""
    n = targets.agg(F.count(F.lit(1)).alias("n_targets"))
    q = F.percentile("n_pred", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    row = each.groupBy("blocker").agg(F.sum("n_hit").alias("covered_matches"), F.sum("n_true").alias("total_true_matches"), F.avg("n_pred").alias("avg_candidates"), q.alias("q"), F.max("n_pred").alias("max_candidates"), F.sum("n_pred").alias("pairs"), F.count(F.lit(1)).alias("n_s1")).crossJoin(F.broadcast(n))
    return row.select(
        "blocker",
        F.round(F.when(F.col("total_true_matches") > 0, F.col("covered_matches") / F.col("total_true_matches")).otherwise(0.0), 4).alias("recall"),
        "covered_matches",
        "total_true_matches",
        F.round("avg_candidates", 2).alias("avg_candidates"),
        F.col("q")[0].alias("median_candidates"),
        F.col("q")[1].alias("p90"),
        F.col("q")[2].alias("p95"),
        F.col("q")[3].alias("p99"),
        "max_candidates",
        F.round(F.when((F.col("n_s1") > 0) & (F.col("n_targets") > 0), 1.0 - F.col("pairs") / (F.col("n_s1") * F.col("n_targets"))).otherwise(0.0), 6).alias("reduction_ratio"),
    )
