"""The linkage pipeline: training with validation, and prediction, each as DataFrame plans."""

from __future__ import annotations

import csv
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import candidates, decide, metrics, model
from linkloom.operators.features import pair_features
from linkloom.sources import records
from linkloom.sources.stages import staged


def score(s1: DataFrame, targets: DataFrame, matcher: model.Matcher, preset: str | list[str] = "baseline_parity", partition_by_country: bool = False, **options: dict) -> tuple[DataFrame, DataFrame]:
    """(candidates, scored candidates) of normalised records."""
    found = staged(candidates.generate(s1, targets, preset, partition_by_country, **options), "candidates")
    scored = matcher.predict_proba(pair_features(found, s1, targets)).select("s1_id", "target_id", "score", "route_rank", "ord")
    return found, scored


def train(s1: DataFrame, targets: DataFrame, truth: DataFrame, train_entities: int = 28_000, validation_entities: int = 12_000, matcher: model.Matcher | None = None, preset: str | list[str] = "baseline_parity", max_matches: int = 10, report: str | None = None, model_path: str | None = None, **options: dict) -> dict:
    """Fits on the first entities, sweeps thresholds on those after them, and reports metrics and cohorts.

    s1 and targets are normalised records, truth pairs (s1_id, target_id).
    """
    began = time.time()
    first, held = model.split_entities(s1, train_entities, validation_entities)
    first, held, targets = staged(first, "train"), staged(held, "validation"), staged(targets, "targets")
    pairs = candidates.generate(first, targets, preset, **options)
    labelled = staged(model.label_pairs(pair_features(pairs, first, targets), truth), "pairs")
    matcher = (matcher or model.baseline_matcher()).fit(labelled)
    if model_path:
        matcher.save(model_path)
    found, scored = score(held, targets, matcher, preset, **options)
    scored = staged(scored, "scored")
    entities = held.select(F.col("entity_id").alias("s1_id"))
    true = truth.join(entities, "s1_id", "left_semi")
    grid = model.linspace(0.35, 0.85, 51, 3)
    threshold, best = model.find_optimal_threshold(model.threshold_sweep(scored, true, held, grid, max_matches))
    accepted = staged(decide.decide(scored, threshold, max_matches), "accepted")
    out = {
        "optimal_threshold": threshold,
        "best_macro_f05": best,
        "metrics": metrics.evaluate(accepted, true, entities).first().asDict(),
        "candidate_recall": metrics.candidate_recall(found, true, entities).first().asDict(),
        "cohorts": {r["cohort"]: r.asDict() for r in metrics.cohorts(accepted, true, entities).collect()},
        "runtime_s": round(time.time() - began, 2),
    }
    if report:
        with open(report, "w", encoding="utf-8") as f:
            json.dump(out, f, indent=2)
    return out | {"matcher": matcher}


def load_threshold(report: str, default: float = 0.55) -> float:
    """The threshold of a training report; the default if there is none."""
    try:
        with open(report, encoding="utf-8") as f:
            return float(json.load(f).get("optimal_threshold", default))
    except FileNotFoundError:
        return default


def predict(s1: DataFrame, targets: DataFrame, matcher: model.Matcher, threshold: float, max_matches: int = 10, countries: list[str] | None = None, preset: str | list[str] = "baseline_parity", **options: dict) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) as lists for every S1 record in its order; records of other countries than `countries` get empty lists.

    All countries are one job: the country is part of the keys.  Matches are always candidates.
    """
    some = s1 if countries is None else s1.where(F.lower(F.trim("country")).isin([c.strip().lower() for c in countries]))
    found, scored = score(some, targets, matcher, preset, True, **options)
    accepted = candidates.within(decide.decide(scored, threshold, max_matches), found)
    ids = accepted.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id"))), lambda x: x["target_id"]).alias("matched_entity_ids"))
    lists = candidates.nested(found).withColumnRenamed("s1_id", "source1_entity_id")
    return records.assemble(s1, ids, "matched_entity_ids"), records.assemble(s1, lists, "candidate_entity_ids")


#: Columns of the experiment log (fixed names).
EXPERIMENT_COLUMNS = ["experiment_id", "date", "git_commit", "hypothesis", "change", "configuration", "candidate_recall", "candidate_count", "precision", "recall", "macro_f0_5", "singleton_accuracy", "runtime", "status", "notes"]


def experiment(out: dict, experiment_id: str, commit: str = "", notes: str = "", **columns: str) -> dict:
    """The log line of a result of train(); columns gives what can't be told from it."""
    found, measured = out["candidate_recall"], out["metrics"]
    four = lambda x: "" if x is None else round(x, 4)
    known = {
        "experiment_id": experiment_id,
        "date": time.strftime("%Y-%m-%d"),
        "git_commit": commit,
        "configuration": f"threshold={out['optimal_threshold']}",
        "candidate_recall": four(found["candidate_recall"]),
        "candidate_count": found["total_candidate_pairs"],
        "precision": four(measured["mean_precision"]),
        "recall": four(measured["mean_recall"]),
        "macro_f0_5": four(measured["macro_f0_5"]),
        "singleton_accuracy": four(measured["singleton_accuracy"]),
        "runtime": f"{out['runtime_s']:.1f}s",
        "notes": notes,
    } | columns
    return {k: str(known.get(k, "")) for k in EXPERIMENT_COLUMNS}


def append_experiment(row: dict, path: str) -> None:
    """Appends one line to the log, a local file, with the header where it is new."""
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, EXPERIMENT_COLUMNS)
        if new:
            w.writeheader()
        w.writerow(row)
