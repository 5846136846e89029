"""Command line: python -m linkloom.cli VERB ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import candidates, metrics, model, profile, validate
from linkloom.operators.records import normalize
from linkloom.operators.routes import BY_NAME
from linkloom.plans import linkage
from linkloom.sources import records


def _sources(spark: SparkSession, args) -> tuple[DataFrame, DataFrame]:
    s1 = normalize(records.with_order(records.read_source(spark, args.source1)))
    targets = normalize(records.with_order(records.read_source(spark, [args.source2, args.source3])))
    return linkage.staged(s1, "s1"), linkage.staged(targets, "targets")


def _truth(spark: SparkSession, args) -> DataFrame:
    rows = records.read_truth(spark, args.truth)
    return rows.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(text.parse_ids(F.col("matched_entity_ids"))).alias("target_id"))


def candidates_verb(spark, args) -> int:
    s1, targets = _sources(spark, args)
    lists = candidates.nested(candidates.generate(s1, targets, args.preset, args.by_country)).withColumnRenamed("s1_id", "source1_entity_id")
    records.write_candidate_pairs(records.assemble(s1, lists, "candidate_entity_ids"), args.out)
    return 0


def features_verb(spark, args) -> int:
    from linkloom.operators.features import pair_features

    s1, targets = _sources(spark, args)
    pair_features(linkage.staged(candidates.generate(s1, targets, args.preset, args.by_country), "candidates"), s1, targets).write.mode("overwrite").parquet(args.out)
    return 0


def train_verb(spark, args) -> int:
    s1, targets = _sources(spark, args)
    out = linkage.train(s1, targets, _truth(spark, args), args.train_entities, args.validation_entities, preset=args.preset, report=args.report, model_path=args.model)
    print(json.dumps({k: v for k, v in out.items() if k != "matcher"}, indent=2))
    if args.log:
        linkage.append_experiment(linkage.experiment(out, args.experiment, args.commit, args.notes), args.log)
    return 0


def predict_verb(spark, args) -> int:
    s1, targets = _sources(spark, args)
    matcher = model.GradientBoostedMatcher.load(spark, args.model)
    matches, lists = linkage.predict(s1, targets, matcher, linkage.load_threshold(args.report), countries=args.countries, preset=args.preset)
    records.write_matching_results(matches, f"{args.out}/matching_results.tsv")
    records.write_candidate_pairs(lists, f"{args.out}/candidate_pairs.tsv")
    ok, found = validate.verify_invariants(spark, f"{args.out}/matching_results.tsv", f"{args.out}/candidate_pairs.tsv", args.source1)
    found.show(truncate=False)
    return 0 if ok else 1


def evaluate_verb(spark, args) -> int:
    rows = records.read_tsv(spark, args.matching, records.MATCH_COLUMNS)
    pairs = rows.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(text.parse_ids(F.col("matched_entity_ids"))).alias("target_id"))
    truth, entities = _truth(spark, args), records.read_truth(spark, args.truth).select(F.trim("source1_entity_id").alias("s1_id"))
    metrics.evaluate(pairs, truth, entities).show(truncate=False)
    metrics.cohorts(pairs, truth, entities).show(truncate=False)
    return 0


def validate_verb(spark, args) -> int:
    found = validate.validate(spark, args.matching, args.candidates, args.test_dir, args.check_ids)
    found.show(100, truncate=False)
    ok = validate.passes(found)
    if ok and args.package:
        records.package([p for p in (args.matching, args.candidates) if p], args.package)
    return 0 if ok else 1


def profile_verb(spark, args) -> int:
    for path in args.files:
        print(json.dumps(records.inspect_file(spark, path)))
        if args.truth_file:
            rows = records.read_truth(spark, path)
            profile.truth(rows).show(truncate=False)
            profile.cardinalities(rows).show(truncate=False)
        else:
            rows = records.with_order(records.read_source(spark, path, args.max_rows))
            for df in (profile.source(rows), profile.countries(rows), profile.frequent(rows)):
                df.show(100, truncate=False)
    return 0


def bench_verb(spark, args) -> int:
    s1, targets = _sources(spark, args)
    truth = _truth(spark, args)
    found, seconds = {}, {}
    for r in args.routes:
        began = time.time()
        found[r] = linkage.staged(BY_NAME[r](s1, targets), r)
        seconds[r] = round(time.time() - began, 2)
    began = time.time()
    every = linkage.staged(candidates.merge(list(found.values())), "all")
    seconds["+".join(args.routes)] = round(sum(seconds.values()) + time.time() - began, 2)
    for name, df in [*found.items(), ("+".join(args.routes), every)]:
        metrics.blocking_stats(df, truth, s1, targets, name).withColumn("seconds", F.lit(seconds[name])).show(truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkloom")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name, run, sources=False, truth=False):
        v = verbs.add_parser(name)
        v.set_defaults(run=run)
        if sources:
            for n in (1, 2, 3):
                v.add_argument(f"--source{n}", required=True)
            v.add_argument("--preset", default="baseline_parity", choices=sorted(candidates.PRESETS))
            v.add_argument("--by-country", action="store_true")
        if truth:
            v.add_argument("--truth", required=True)
        return v

    for name, run in (("candidates", candidates_verb), ("features", features_verb)):
        verb(name, run, True).add_argument("--out", required=True)
    v = verb("train", train_verb, True, True)
    v.add_argument("--train-entities", type=int, default=28_000)
    v.add_argument("--validation-entities", type=int, default=12_000)
    v.add_argument("--report", required=True)
    v.add_argument("--model", required=True)
    v.add_argument("--log")
    v.add_argument("--experiment", default="")
    v.add_argument("--commit", default="")
    v.add_argument("--notes", default="")
    v = verb("predict", predict_verb, True)
    v.add_argument("--model", required=True)
    v.add_argument("--report", required=True)
    v.add_argument("--countries", nargs="*")
    v.add_argument("--out", required=True)
    verb("evaluate", evaluate_verb, truth=True).add_argument("--matching", required=True)
    v = verb("validate", validate_verb)
    v.add_argument("--matching", required=True)
    v.add_argument("--candidates")
    v.add_argument("--test-dir", required=True)
    v.add_argument("--check-ids", action="store_true")
    v.add_argument("--package")
    v = verb("profile", profile_verb)
    v.add_argument("files", nargs="+")
    v.add_argument("--truth-file", action="store_true")
    v.add_argument("--max-rows", type=int)
    v = verb("bench-blocking", bench_verb, True, True)
    v.add_argument("--routes", nargs="+", default=list(BY_NAME), choices=list(BY_NAME))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
