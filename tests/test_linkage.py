"""Linkage operators on small records, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import candidates, decide, evidence, features, metrics, model, routes, validate
from linkloom.operators.records import normalize
from linkloom.sources import records

ROWS = [
    ("S2-21", "Borealis Pump Corp.", "88 Harbour St, Ste 12", "US"),
    ("S1-11", "Borealis Pump Corporation", "88 Harbour Street, Suite 12", "US"),
    ("S3-31", "Borealis Pump Corp", "88 Harbour Street", "US"),
    ("S1-12", "Quillfeather Textiles Ltd", "17 Saltmarsh Road", "US"),
    ("S2-22", "Quillfeather Textiles", "17 Saltmarsh Rd", "US"),
    ("S3-32", "Quillfeather Textiles Limited", "", "US"),
    ("S1-13", "Night Heron Bakery", "9 Orchard Boulevard", "US"),
    ("S1-14", "Puno Reed Boats", "30 Lago Avenue", "Peru"),
    ("S2-90", "Zygmunt Via Kft", "6021 Delta Quay", "US"),
]


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, entity_id string, business_name string, business_address string, country string")


@pytest.fixture(scope="module")
def sides(spark):
    n = normalize(table(spark, ROWS)).cache()
    return n.where("entity_id like 'S1-%'"), n.where("entity_id not like 'S1-%'")


def pairs(df):
    return {(r.s1_id, r.target_id) for r in df.collect()}


def test_normal_forms(spark):
    got = one(spark, text.business_name(F.lit("Borealis Pump Corporation")), text.business_name(F.lit("Quillfeather Textiles, Limited")), text.address(F.lit("88 Harbour Street, Suite 12")), text.business_name(F.lit("Café L.L.C.")), text.business_name(F.lit(None).cast("string")), text.clean_unicode(F.lit("ﬁ ½ 각")), text.business_name(F.lit("NA")))
    assert tuple(got) == ("borealis pump corp", "quillfeather textiles ltd", "88 harbour st ste 12", "cafe l l c", "", "fi 1⁄2 각", "na")


def test_numbers_and_grams(spark):
    got = one(spark, text.numeric_anchors(F.lit("402/B, 12-56 x9 122011 12")), text.char_ngrams(F.lit("acme")), text.char_ngrams(F.lit("")), text.char_ngrams(F.lit("a")), text.char_ngrams(F.lit("a"), 4))
    assert got[0] == ["402", "12", "56", "122011", "12"]
    assert got[1:] == ([" ac", "acm", "cme", "me "], [], [" a "], [" a "])


def test_trigram_numbers_are_the_trigrams(spark):
    for word in ("acme", "", "a", "aaaaaa", "é𝄞 😀z", "x y"):
        grams, numbers = one(spark, text.char_ngrams(F.lit(word)), text.trigram_numbers(F.lit(word)))
        assert numbers == [sum(ord(c) << 21 * (2 - i) for i, c in enumerate(g)) for g in grams]


def test_soundex(spark):
    words = ["Robert", "Rupert", "Smith", "Smythe", "Ashcraft", "x9", ""]
    assert list(one(spark, *(text.soundex(F.lit(w)) for w in words))) == ["R163", "R163", "S530", "S530", "A226", "", ""]


def test_similarities(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    got = one(spark, text.jaccard(a(), a()), text.jaccard(a("x"), a()), text.jaccard(a("x", "y", "y"), a("y", "z")), text.edit_similarity(F.lit(""), F.lit("")), text.edit_similarity(F.lit("ab"), F.lit("")), text.edit_similarity(F.lit("abcd"), F.lit("abce")), text.edit_similarity(F.lit("ab"), F.lit("abcdef")), text.edit_similarity(F.lit("é"), F.lit("e")))
    assert list(got) == [1.0, 0.0, 1 / 3, 1.0, 0.0, 0.75, 0.0, 0.0]


def test_id_lists(spark):
    raw = F.lit(" S3-9, S2-4, S3-9,, S2-7 ")
    got = one(spark, text.parse_ids(raw), text.format_ids(text.parse_ids(raw)), text.parse_ids(F.lit(None).cast("string")))
    assert list(got) == [["S3-9", "S2-4", "S3-9", "S2-7"], "S3-9,S2-4,S2-7", []]


def test_missing_address_by_punctuation(spark):
    n = normalize(table(spark, [("S1-1", "a", " -,. ", "US"), ("S1-2", "a", None, None)])).collect()
    assert all(r.is_address_missing for r in n) and n[1].country == ""


def test_exact_routes(sides):
    assert pairs(routes.exact_name(*sides)) == {("S1-11", "S2-21"), ("S1-11", "S3-31"), ("S1-12", "S3-32")}
    assert pairs(routes.exact_address(*sides)) == {("S1-11", "S2-21"), ("S1-12", "S2-22")}
    assert pairs(routes.exact_name_and_address(*sides)) == {("S1-11", "S2-21")}


def test_caps_take_the_first_in_scan_order(spark):
    n = normalize(table(spark, [("S1-1", "x", "", "A"), *[(f"S2-{i}", "x", "", "A" if i % 2 else "B") for i in range(9)]]))
    s1, t = n.where("entity_id like 'S1%'"), n.where("entity_id like 'S2%'")
    assert pairs(routes.exact_name(s1, t, max_candidates_per_key=3)) == {("S1-1", f"S2-{i}") for i in range(3)}
    assert pairs(routes.exact_name(s1, t, True, 3)) == {("S1-1", f"S2-{i}") for i in (1, 3, 5)}


def test_repeated_numbers_take_cap(spark):
    n = normalize(table(spark, [("S1-1", "zz", "777", "A"), ("S2-1", "yy", "777 and 777", "A"), ("S2-2", "yy", "777", "A")]))
    s1, t = n.where("entity_id like 'S1%'"), n.where("entity_id like 'S2%'")
    assert pairs(routes.numeric_anchors(s1, t, max_candidates_per_key=2)) == {("S1-1", "S2-1")}
    assert pairs(routes.numeric_anchors(s1, t)) == {("S1-1", "S2-1"), ("S1-1", "S2-2")}


def test_rare_tokens_overshoot(spark):
    rows = [("S1-1", "alpha bravo charlie", "", "")] + [(f"S2-{i}", "alpha" if i < 3 else "bravo" if i < 6 else "charlie", "", "") for i in range(9)]
    n = normalize(table(spark, rows))
    s1, t = n.where("entity_id like 'S1%'"), n.where("entity_id like 'S2%'")
    assert pairs(routes.rare_tokens(s1, t, 2, 50, 4)) == {("S1-1", f"S2-{i}") for i in range(6)}
    assert pairs(routes.rare_tokens(s1, t, 4, 50, 4)) == set()


def test_rare_tokens_by_occurrence_drop_the_26th(spark):
    rows = [("S1-1", "marten osprey plover", "", ""), *[(f"S2-{i}", "marten marten" if i < 12 else "osprey", "", "") for i in range(38)], ("S2-90", "marten", "", ""), ("S2-91", "plover", "", "")]
    n = normalize(table(spark, rows))
    s1, t = n.where("entity_id like 'S1%'"), n.where("entity_id like 'S2%'")
    assert pairs(routes.rare_tokens_by_occurrence(s1, t)) == {("S1-1", f"S2-{i}") for i in [*range(12), 90]}  # 25 martens, 26 ospreys, one plover


def test_other_routes(sides):
    assert ("S1-11", "S3-31") in pairs(routes.phonetic(*sides))
    assert pairs(routes.char_ngram(*sides, min_overlap=5)) >= {("S1-11", "S2-21"), ("S1-12", "S2-22")}
    got = routes.tfidf(*sides).collect()
    assert {(r.s1_id, r.target_id) for r in got} >= {("S1-11", "S2-21"), ("S1-11", "S3-31"), ("S1-12", "S2-22")}
    assert all(0.4 <= r.score <= 1 + 1e-9 for r in got)


def test_tfidf_lead_terms_lose_no_pair(spark):
    import math
    import random
    from collections import Counter

    random.seed(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"S{1 if i < 12 else 2}-{i}", " ".join(random.choices(words, weights=range(12, 0, -1), k=random.randint(1, 7))), "", "") for i in range(60)]
    n = normalize(table(spark, rows))
    got = {(r.s1_id, r.target_id): r.score for r in routes.tfidf(n.where("entity_id like 'S1-%'"), n.where("entity_id like 'S2-%'"), top_k=1000, ngram_range=(1, 1)).collect()}
    docs = {r[0]: Counter(r[1].split()) for r in rows}
    targets = {k: v for k, v in docs.items() if k.startswith("S2")}
    df = Counter(w for v in targets.values() for w in v)

    def vector(c):
        raw = {w: tf * (math.log((len(targets) + 1) / (df[w] + 1)) + 1) for w, tf in c.items() if w in df}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    want = {}
    for a in docs:
        for b in targets:
            if a.startswith("S1"):
                va, vb = vector(docs[a]), vector(docs[b])
                if (s := sum(va[w] * vb.get(w, 0) for w in va)) >= 0.4:
                    want[a, b] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_merge_and_sets(spark, sides):
    a = spark.createDataFrame([("S1-1", "S2-1", "exact_name", 1.0, 1), (" S1-1", "S2-1 ", "tfidf", 0.85, 1), ("S1-1", "S2-1", "tfidf", 0.7, 1), ("S1-1", "", "tfidf", 0.7, 1)], "s1_id string, target_id string, route string, score double, ord long")
    b = spark.createDataFrame([("S1-1", "S3-1", "exact_address", 1.0, 2)], a.schema)
    m = {r.target_id: r for r in candidates.merge([a, b]).collect()}
    assert m["S2-1"].route_scores == {"exact_name": 1.0, "tfidf": 0.85} and m["S3-1"].routes == ["exact_address"] and len(m) == 2
    whole = candidates.merge([a, b])
    assert pairs(candidates.missing_pairs(whole, candidates.merge([b]))) == {("S1-1", "S2-1")}
    assert pairs(candidates.within(whole, candidates.merge([b]))) == {("S1-1", "S3-1")}
    assert candidates.nested(whole).first().candidate_entity_ids == ["S2-1", "S3-1"] and candidates.total_pairs(whole) == 2
    assert {r.s1_id for r in candidates.generate(*sides, preset="full").collect()} >= {"S1-11", "S1-12"}


def test_pair_features(sides):
    s1, t = sides
    found = candidates.generate(s1, t, ["exact_name", "exact_address"])
    f = {(r.s1_id, r.target_id): r.asDict() for r in features.pair_features(found, s1, t).collect()}
    full, missing = f["S1-11", "S2-21"], f["S1-12", "S3-32"]
    assert list(full)[4:] == features.FEATURE_NAMES
    assert full["interaction_both_strong"] == 1.0 and full["num_routes_retrieved"] == 2.0 and full["addr_numeric_overlap"] == 2.0
    assert missing["addr_missing_target"] == 1.0 and missing["addr_missing_s1"] == 0.0 and missing["addr_token_jaccard"] == 0.0 and missing["interaction_name_strong_addr_missing"] == 1.0
    r = features.retrieval_features(found).where("target_id = 'S2-21'").first()
    assert r.route_exact_name == 1.0 and r.route_tfidf == 0.0 and r.max_route_score == 1.0


def scored(spark, rows):
    return spark.createDataFrame([(s, t, float(x), 1, i) for i, (s, t, x) in enumerate(rows)], "s1_id string, target_id string, score double, route_rank int, ord long")


def test_decisions(spark, sides):
    df = scored(spark, [("a", "S2-1", 0.91), ("a", "S2-2", 0.37), ("a", "S3-1", 0.86), ("b", "S2-1", 0.3), *[("c", f"S2-{i}", 0.9) for i in range(10)]])
    got = decide.decide(df, 0.5, 3).orderBy("s1_id", "rank").collect()
    assert [(r.s1_id, r.target_id) for r in got] == [("a", "S2-1"), ("a", "S3-1"), ("c", "S2-0"), ("c", "S2-1"), ("c", "S2-2")]
    assert decide.decide(df, 0.5, 1).where("s1_id = 'c'").count() == 2  # the cap is first looked at after two
    s1 = spark.createDataFrame([("b", 0), ("a", 1), ("z", 2)], "entity_id string, ord long")
    every = {r.source1_entity_id: r.matched_entity_ids for r in decide.decide_all(df, s1).collect()}
    assert every == {"a": ["S2-1", "S3-1"], "b": [], "z": []}
    kept = decide.source_thresholds(df.where("s1_id = 'a'"), 0.95, 0.8)
    assert pairs(kept) == {("a", "S3-1")}


def test_ambiguity(spark):
    df = scored(spark, [("a", "x", 0.77), ("a", "y", 0.76), ("b", "x", 0.93), ("b", "y", 0.55), ("c", "x", 0.7)])
    got = {r.s1_id: r for r in decide.ambiguous(df).collect()}
    assert got["a"].is_ambiguous and not got["b"].is_ambiguous and not got["c"].is_ambiguous
    assert abs(got["b"].margin - 0.38) < 1e-9 and got["c"].margin == 1.0


def test_evidence(spark, sides):
    _, t = sides
    r = one(spark, *evidence.triangle_support(F.lit(0.95), F.lit(0.81), F.lit(0.86), 0.7).values(), *evidence.triangle_support(F.lit(0.8), F.lit(0.4), F.lit(0.1), 0.7).values())
    assert r[0] and r[1] == 0.81 and not r[3]
    found = scored(spark, [("S1-11", "S2-21", 0.9), ("S1-11", "S3-31", 0.9), ("S1-11", "S2-90", 0.9)])
    w = {x.target_id: (x.witness_id, x.witness_score) for x in evidence.strongest_witness(found, t).collect()}
    assert w["S2-21"][0] == "S3-31" and w["S2-21"][1] > 0.8 and w["S2-90"] == (None, 0.0)
    rel = {x.s2_id: x.relationship for x in evidence.relationships(found, t).collect()}
    assert rel == {"S2-21": "support", "S2-90": "contradiction"}
    assert {x.s2_id: x.is_closed for x in evidence.triangles(found, t).collect()} == {"S2-21": True, "S2-90": False}


def links(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, target_id string")


def test_metrics(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    truth = links(spark, [("a", "S2-1"), ("a", "S3-1"), ("b", "S2-9")])
    pred = links(spark, [("a", "S2-1"), ("a", "S3-1"), ("a", "S2-7"), ("a", "S2-7")])
    each = {r.s1_id: r for r in metrics.per_entity(pred, truth, entities).collect()}
    assert (each["a"].precision, each["a"].recall) == (2 / 3, 1.0) and abs(each["a"].f05 - 5 / 7) < 1e-12
    assert each["b"].f05 == 0.0 and each["c"].f05 == 1.0
    e = metrics.evaluate(pred, truth, entities).first()
    assert e.singleton_accuracy == 1.0 and e.total_entities == 3 and abs(e.macro_f0_5 - (5 / 7 + 1) / 3) < 1e-12
    c = {r.cohort: r for r in metrics.cohorts(pred, truth, entities).collect()}
    assert len(c) == 7 and c["both_sources"]["count"] == 1.0 and c["s3_only"]["count"] == 0.0 and c["s2_only"].macro_f0_5 == 0.0
    r = metrics.candidate_recall(pred, truth, entities).first()
    assert r.covered_matches == 2 and r.total_true_matches == 3 and r.total_candidate_pairs == 3
    assert metrics.macro_f05(pred.limit(0), truth.limit(0), entities.limit(0)).first()[0] == 0.0


def test_threshold_sweep(spark):
    s1 = spark.createDataFrame([("a", 0), ("b", 1)], "entity_id string, ord long")
    truth = links(spark, [("a", "S2-1")])
    df = scored(spark, [("a", "S2-1", 0.9), ("a", "S2-2", 0.6), ("b", "S2-1", 0.5)])
    got = {round(r.threshold, 2): r.macro_f05 for r in model.threshold_sweep(df, truth, s1, [0.4, 0.55, 0.7, 0.95]).collect()}
    f = 1.25 * 0.5 / (0.125 + 1)
    assert {k: round(v, 9) for k, v in got.items()} == {0.4: round(f / 2, 9), 0.55: round((f + 1) / 2, 9), 0.7: 1.0, 0.95: 0.5}
    assert model.find_optimal_threshold(model.threshold_sweep(df, truth, s1, [0.7, 0.8])) == (0.7, 1.0)
    assert model.find_optimal_threshold(lambda t: -2.0) == (0.5, -1.0)


def test_files_and_checks(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1", 0), ("S1-2", 1), ("S1-3", 2)], "entity_id string, ord long")
    found = spark.createDataFrame([("S1-1", ["S2-1", "S3-1", "S2-1"]), ("S1-3", ["S2-9"])], "source1_entity_id string, x array<string>")
    records.write_matching_results(records.assemble(s1, found.withColumnRenamed("x", "matched_entity_ids"), "matched_entity_ids"), f"{tmp_path}/m.tsv")
    records.write_candidate_pairs(records.assemble(s1, found.withColumnRenamed("x", "candidate_entity_ids"), "candidate_entity_ids"), f"{tmp_path}/c.tsv")
    assert (tmp_path / "m.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS2-9\n"
    (tmp_path / "test_source1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tUS\nS1-2\tb\tc\tUS\nS1-3\t\td\tUS\n")
    ok, notes = validate.verify_invariants(spark, f"{tmp_path}/m.tsv", f"{tmp_path}/c.tsv", f"{tmp_path}/test_source1.tsv")
    assert ok, notes.collect()
    assert validate.passes(validate.validate(spark, f"{tmp_path}/m.tsv", f"{tmp_path}/c.tsv", str(tmp_path)))
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS1-1,S2-5,S2-5\nS1-1\tX-1\nS1-9\t\nrubbish\n")
    ok, notes = validate.verify_invariants(spark, f"{tmp_path}/bad.tsv", f"{tmp_path}/c.tsv", f"{tmp_path}/test_source1.tsv")
    rules = {r.rule: r.n for r in notes.collect()}
    assert not ok and rules["matching: required S1 id missing"] == 2 and rules["matching: match is no candidate"] == 1
    assert {"matching: self match", "matching: repeated id in a list", "matching: duplicate S1 row", "matching: wrong prefix", "matching: malformed row", "matching: S1 id not required"} <= set(rules)
    warned = {(r.severity, r.rule) for r in validate.validate(spark, f"{tmp_path}/bad.tsv", f"{tmp_path}/c.tsv", str(tmp_path)).collect()}
    assert ("warning", "matching: match is no candidate") in warned
    (tmp_path / "comma.tsv").write_text("source1_entity_id,matched_entity_ids\n")
    assert not validate.passes(validate.validate(spark, f"{tmp_path}/comma.tsv", None, str(tmp_path)))
    read = records.read_source(spark, f"{tmp_path}/test_source1.tsv").collect()
    assert [r.business_name for r in read] == ["NA", "b", ""]
    with pytest.raises(ValueError):
        records.read_source(spark, f"{tmp_path}/test_source1.tsv", usecols=["nope"])
    assert records.inspect_file(spark, f"{tmp_path}/test_source1.tsv")["delimiter"] == "\t"
    records.package([f"{tmp_path}/m.tsv"], f"{tmp_path}/out.zip")
    with pytest.raises(TypeError):
        records.write_results({}, f"{tmp_path}/x.tsv", "a", "b")


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([("a", "x", 0), ("b", "y", 1), ("a", "z", 2), ("c", "w", 3)], "entity_id string, v string, ord long")
    assert {(r.entity_id, r.v, r.ord) for r in records.dedup_targets(t).collect()} == {("a", "z", 0), ("b", "y", 1), ("c", "w", 3)}
    truth = spark.createDataFrame([("s", ["c"])], "s1_id string, matches array<string>")
    assert {r.entity_id for r in records.target_pool(t, truth, 1).collect()} == {"a", "c"}
    (tmp_path / "c.yaml").write_text("a: {b: 1}\n")
    (tmp_path / "e.yaml").write_text("")
    (tmp_path / "x.yaml").write_text("a: [")
    assert records.load_config(f"{tmp_path}/c.yaml") == {"a": {"b": 1}} and records.load_config(f"{tmp_path}/e.yaml") == {}
    for name, error in (("x.yaml", ValueError), ("none.yaml", FileNotFoundError)):
        with pytest.raises(error):
            records.load_config(f"{tmp_path}/{name}")
    n = normalize(table(spark, ROWS))
    records.write_partitioned(n.where("entity_id like 'S1%'"), n.where("entity_id not like 'S1%'"), f"{tmp_path}/p")
    assert records.read_country(spark, f"{tmp_path}/p", "s1", [" PERU "]).count() == 1 and records.read_country(spark, f"{tmp_path}/p", "targets").count() == 5


def test_train_and_predict(spark, tmp_path, sides):
    from linkloom.plans import linkage

    rows = [(f"S{k + 1}-{i}", f"firm number{i} {'alpha' if i % 2 else 'beta'}", f"{i + 100} long street", "US") for i in range(40) for k in range(3)]
    n = normalize(table(spark, rows)).cache()
    s1, t = n.where("entity_id like 'S1%'"), n.where("entity_id not like 'S1%'")
    truth = s1.select(F.col("entity_id").alias("s1_id"), F.explode(F.array(*(F.concat(F.lit(f"S{k}-"), F.substring("entity_id", 4, 9)) for k in (2, 3)))).alias("target_id"))
    out = linkage.train(s1, t, truth, 25, 15, model.GradientBoostedMatcher(2, 0.3, 2), ["exact_name", "exact_address", "phonetic"], report=f"{tmp_path}/r.json", model_path=f"{tmp_path}/model")
    assert out["metrics"]["macro_f0_5"] > 0.9 and out["candidate_recall"]["candidate_recall"] == 1.0
    again = model.GradientBoostedMatcher.load(spark, f"{tmp_path}/model")
    with pytest.raises(FileNotFoundError):
        model.GradientBoostedMatcher.load(spark, f"{tmp_path}/none")
    matches, lists = linkage.predict(s1, t, again, linkage.load_threshold(f"{tmp_path}/r.json"), countries=["us"])
    got = {r.source1_entity_id: set(r.matched_entity_ids) for r in matches.collect()}
    assert len(got) == 40 and got["S1-7"] == {"S2-7", "S3-7"}
    assert linkage.load_threshold(f"{tmp_path}/none.json") == 0.55


def test_streamed_arrivals(spark, tmp_path, sides):
    from linkloom.streaming import arrivals

    table(spark, [r for r in ROWS if r[0].startswith("S1")]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table(spark, ROWS[:1]).schema).parquet(f"{tmp_path}/in")
    q = arrivals.write_arrivals(arrivals.match_arrivals(stream, arrivals.postings(sides[1])), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert pairs(spark.read.parquet(f"{tmp_path}/out")) == pairs(routes.exact_name(*sides)) | pairs(routes.exact_address(*sides))


def test_command_line_parses():
    from linkloom import cli

    args = cli.parser().parse_args(["validate", "--matching", "m", "--test-dir", "d", "--check-ids"])
    assert args.run is cli.validate_verb and args.check_ids


def write_tsv(path, columns, rows):
    path.write_text("\t".join(columns) + "\n" + "".join("\t".join(r) + "\n" for r in rows))
    return str(path)


def test_verbs_end_to_end(spark, tmp_path, capsys):
    from linkloom import cli

    kinds = ("alpha", "beta", "gamma")
    rows = [(f"S{k + 1}-{i}", f"firm number{i} {kinds[i % 3]}", f"{i + 100} long street", "US" if i % 2 else "Peru") for i in range(30) for k in range(3)]
    sources = [a for n in (1, 2, 3) for a in (f"--source{n}", write_tsv(tmp_path / f"test_source{n}.tsv", records.SOURCE_COLUMNS, [r for r in rows if r[0].startswith(f"S{n}")]))]
    truth = write_tsv(tmp_path / "truth.tsv", records.TRUTH_COLUMNS, [(f"S1-{i}", f"S2-{i},S3-{i}") for i in range(30)])
    p = lambda name: str(tmp_path / name)
    run = lambda *args: cli.main(list(args))

    class Small(model.GradientBoostedMatcher):
        def __init__(self, *args):
            super().__init__(2, 0.3, 2)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(model, "baseline_matcher", Small)
        m.setattr(cli, "SparkSession", type("S", (), {"builder": type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})()}))
        assert run("candidates", *sources, "--preset", "baseline_parity", "--out", p("c.tsv")) == 0
        lines = (tmp_path / "c.tsv").read_text().splitlines()
        assert lines[0].split("\t") == records.CANDIDATE_COLUMNS and len(lines) == 31 and lines[1] == "S1-0\tS2-0,S3-0"
        assert run("features", *sources, "--out", p("f")) == 0
        assert spark.read.parquet(p("f")).count() == 60
        for _ in range(2):
            assert run("train", *sources, "--truth", truth, "--train-entities", "20", "--validation-entities", "10", "--preset", "full", "--report", p("r.json"), "--model", p("model"), "--log", p("log.csv"), "--experiment", "E1") == 0
        import csv

        from linkloom.plans import linkage

        log = list(csv.reader((tmp_path / "log.csv").open()))
        assert log[0] == linkage.EXPERIMENT_COLUMNS and len(log[0]) == 15 and len(log) == 3 and log[1][0] == "E1" and float(log[1][6]) == 1.0
        assert run("predict", *sources, "--model", p("model"), "--report", p("r.json"), "--preset", "full", "--out", p("out")) == 0
        capsys.readouterr()
        assert run("evaluate", "--truth", truth, "--matching", p("out/matching_results.tsv")) == 0
        assert "macro_f0_5" in capsys.readouterr().out
        assert run("validate", "--matching", p("out/matching_results.tsv"), "--candidates", p("out/candidate_pairs.tsv"), "--test-dir", str(tmp_path), "--check-ids", "--package", p("z.zip")) == 0
        assert (tmp_path / "z.zip").exists()
        assert run("profile", sources[1], "--max-rows", "7") == 0 and "|7 " in capsys.readouterr().out
        assert run("bench-blocking", *sources, "--truth", truth, "--routes", "exact_name", "exact_address") == 0
        assert "seconds" in capsys.readouterr().out


def test_source_files_bring_fields_back(spark, tmp_path):
    odd = [("S1-1", 'say "hi"', " a\tb ", "US"), ("S2-1", "", '"', ""), ("S2-2", "NA", "x\r\ny", "null"), ("S3-1", "a\\b", "\\", "é")]
    records.write_source(table(spark, odd), f"{tmp_path}/s")
    assert sorted(tuple(r) for r in records.read_source(spark, f"{tmp_path}/s").collect()) == sorted(odd)


def test_benchmark_pool_keeps_repeated_ids(spark):
    t = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 3), ("c", 4), ("d", 5)], "entity_id string, ord long")
    truth = spark.createDataFrame([("s", ["c"])], "s1_id string, matches array<string>")
    assert {r.ord for r in records.target_pool(t, truth, 3, dedup=False).collect()} == {0, 1, 2, 3, 4}


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_bridge_keeps_every_s1_record(spark, tmp_path):
    from linkloom.sources import bridge

    texts = [(3, "one two three four five\n1 First St", "en"), (6, "one two three four six\n2 Second St", "en"), (9, "one two three four five\n1 First St", "en"), (12, "short\na\nshort\nb", "en"), (4, "one two three four six\n2 Second St", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets = bridge.sides(spark, str(tmp_path))
    assert {r.entity_id for r in s1.collect()} == {"S1-3-0", "S1-6-0", "S1-9-0", "S1-12-0", "S1-12-1"}
    assert pairs(routes.exact_address(s1, targets)) == {("S1-6-0", "S2-4-0")}
    assert pairs(bridge.truth(s1, targets)) == {("S1-3-0", "S2-4-0"), ("S1-6-0", "S2-4-0"), ("S1-9-0", "S2-4-0")}


def test_char_ngram_query_has_the_limits_of_the_route(spark, tmp_path):
    from linkloom.plans import queries

    names = {3: "acme shop", 6: "zebra", **{3 * i + 1: f"acme store {i}" for i in range(1, 31)}, 2: "zebras", 5: "quite other"}
    spark.createDataFrame([(i, n, "en") for i, n in names.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = {i: {f" {n} "[k : k + 3] for k in range(len(n))} for i, n in names.items()}
    want = {(f"S1-{a}-0", f"S{b % 3 + 1}-{b}-0") for a in names if a % 3 == 0 for b in names if b % 3 and len(grams[a] & grams[b]) >= 3}
    assert len(want) == 31 and pairs(queries.QUERIES["er_route_char_ngram"](spark, str(tmp_path))) == want


def test_composed_queries_have_the_pairs_of_all_blockers(spark, tmp_path):
    from linkloom.plans import queries

    texts = [(3, "robert", "en"), (1, "rupert", "en"), (6, "quick heron", "en"), (2, "blue heron", "en"), (4, "grey heron", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.s1_id, r.target_id): r.routes for r in queries.QUERIES["er_candidate_union"](spark, str(tmp_path)).collect()}
    assert got == {("S1-6-0", "S3-2-0"): "rare_tokens", ("S1-6-0", "S2-4-0"): "rare_tokens", ("S1-3-0", "S2-1-0"): "phonetic"}
    assert set(queries.COMPOSED) == set(routes.ROUTES) - {"char_ngram", "tfidf"}
    assert queries.COMBINATIONS["all blockers"] == queries.COMPOSED and len({tuple(v) for v in queries.COMBINATIONS.values()}) == 7


def test_gbt_scores_every_candidate(spark, tmp_path, monkeypatch):
    from linkloom.plans import queries

    fitted = []

    class Constant:
        def fit(self, pairs):
            fitted.append({r.s1_id for r in pairs.select("s1_id").collect()})
            return self

        def predict_proba(self, pairs):
            assert not fitted[-1] & {r.s1_id for r in pairs.select("s1_id").collect()}
            return pairs.withColumn("score", F.lit(0.5))

    monkeypatch.setattr(model, "baseline_matcher", Constant)
    texts = [(i, f"same name of all\n{i} Street", "en") for i in (1, 2, *range(3, 27, 3))]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["er_gbt_scores"](spark, str(tmp_path)).collect()
    assert len(fitted) == 2 and len(got) == 16 and {(r.s1_id, r.target_id) for r in got} == pairs(queries.QUERIES["er_candidate_union"](spark, str(tmp_path)))


def test_candidate_queries_make_no_rows_of_pairs_before_the_result(spark, tmp_path, monkeypatch):
    from linkloom.operators import compact
    from linkloom.plans import queries
    from linkloom.sources import bridge

    # More than 50 equal names, 100 equal numbers and 200 equal sounds, words of all frequencies, repeats, blanks and marks.
    names = ["acme shop", "Robert  heron", "rupert heron heron", "Corporation", "été 12", "", "zebra 4711"]
    texts = [(i, f"{names[i % 7]}\n{i % 3} North Street 100{i % 2}\nword{i // 3} token{i // 70} alpha\n{'' if i % 4 else 'same road'}", "en" if i % 5 else None) for i in range(450)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets = (df.persist() for df in bridge.sides(spark, str(tmp_path)))
    pairs_of = candidates.generate(s1, targets, queries.COMPOSED).select("s1_id", "target_id", F.array_join("routes", ",").alias("routes"), "route_rank", "ord").persist()
    want = {tuple(r) for r in pairs_of.collect()}
    true = bridge.truth(s1, targets).persist()
    entities = s1.select(F.col("entity_id").alias("s1_id"))
    recall = metrics.candidate_recall(pairs_of, true, entities).first()
    stats = metrics.blocking_stats(pairs_of.where("array_contains(split(routes, ','), 'exact_name')"), true, s1, targets, "name").first()
    lists = {r.s1_id: ",".join(r.candidate_entity_ids) for r in candidates.nested(pairs_of).collect()}

    def none(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(candidates, "generate", none)
    monkeypatch.setattr(bridge, "truth", none)
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))
    assert {tuple(r) for r in run("er_candidate_union").select("s1_id", "target_id", "routes", "route_rank", "ord").collect()} == want
    assert {r.s1_id: r.candidate_entity_ids for r in run("er_candidate_lists").collect()} == lists
    got = run("er_candidate_recall").first()
    assert (got.covered_matches, got.total_true_matches, got.total_candidate_pairs) == (recall.covered_matches, recall.total_true_matches, recall.total_candidate_pairs)
    assert {tuple(r) for r in run("er_blocking_stats").where("blocker = 'name'").collect()} == {tuple(stats)}
    assert compact.CAPS.keys() | {"rare_tokens"} == set(queries.COMPOSED)


#: What the scored queries give, from rows of all pairs: of both sides, all scored pairs, accepted ones, true ones and entities.
SCORED = {
    "er_decide": lambda s1, t, scored, acc, true, every: acc.select("s1_id", "target_id", "score", F.col("rank").cast("long")),
    "er_decide_cap_one": lambda s1, t, scored, acc, true, every: decide.decide(scored, 0.5, 1).select("s1_id", "target_id", "score", F.col("rank").cast("long")),
    "er_decide_all": lambda s1, t, scored, acc, true, every: decide.decide_all(scored, s1, 0.5, 10).select("source1_entity_id", text.format_ids(F.col("matched_entity_ids"))),
    "er_source_thresholds": lambda s1, t, scored, acc, true, every: decide.source_thresholds(scored, 0.6, 0.4).select("s1_id", "target_id", "score"),
    "er_threshold_sweep": lambda s1, t, scored, acc, true, every: model.threshold_sweep(scored, true, s1, model.linspace(0.35, 0.85, 51, 3), 10),
    "er_best_threshold": lambda s1, t, scored, acc, true, every: model.threshold_sweep(scored, true, s1, model.linspace(0.35, 0.85, 51, 3), 10).orderBy(F.desc(F.round("macro_f05", 6)), "threshold").limit(1),
    "er_witness": lambda s1, t, scored, acc, true, every: evidence.strongest_witness(acc, t),
    "er_triangles": lambda s1, t, scored, acc, true, every: evidence.triangles(acc, t),
    "er_relationships": lambda s1, t, scored, acc, true, every: evidence.relationships(acc, t),
    "er_entity_f05": lambda s1, t, scored, acc, true, every: metrics.per_entity(acc, true, every).select("s1_id", "n_pred", "n_true", "n_hit", "precision", "recall", "f05"),
    "er_evaluate": lambda s1, t, scored, acc, true, every: metrics.evaluate(acc, true, every),
    "er_cohorts": lambda s1, t, scored, acc, true, every: metrics.cohorts(acc, true, every),
    "er_violations": lambda s1, t, scored, acc, true, every: validate.violations(*(df.groupBy(F.col("s1_id").alias("s1")).agg(F.collect_list("target_id").alias("ids")) for df in (acc.select("s1_id", "target_id").unionByName(acc.where("rank = 1").select("s1_id", F.col("s1_id").alias("target_id"))), routes.exact_name(s1, t).select("s1_id", "target_id"))), s1.select(F.col("entity_id").alias("s1"))),
}


@pytest.mark.parametrize("name", SCORED)
def test_scored_queries_make_no_rows_of_pairs(spark, tmp_path, monkeypatch, name):
    from linkloom.operators import scoring
    from linkloom.plans import queries
    from linkloom.sources import bridge

    # Equal names, addresses, numbers and sounds beyond their caps, ties, missing addresses, a number that a record repeats.
    names = ["acme shop", "Robert  heron", "rupert heron heron", "Corporation", "été 12", "", "zebra 4711"]
    texts = [(i, f"{names[i % 7]} word{i // 40}\n{i % 3} North Street 100{i % 2} 1000\nRobert of the word{i // 3} alpha\n{'' if i % 4 else 'same road'}", "en" if i % 5 else None) for i in range(250)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets, _, scored = queries._scored(spark, str(tmp_path))
    scored = scored.persist()
    rows = lambda df: sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    accepted = decide.decide(scored, queries.THRESHOLD, queries.MAX_MATCHES)
    want = SCORED[name](s1, targets, scored, accepted, bridge.truth(s1, targets), s1.select(F.col("entity_id").alias("s1_id")))

    def none(*_, **__):
        raise AssertionError("pairs are made")

    want = rows(want)
    for module, f in ((candidates, "generate"), (features, "with_records"), (bridge, "truth")):
        monkeypatch.setattr(module, f, none)
    monkeypatch.setattr(scoring, "SHARE", 7)
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert rows(got) == want and want


def test_result_files_make_no_rows_of_pairs(spark, tmp_path, monkeypatch):
    from linkloom.plans import queries
    from linkloom.sources import bridge

    texts = [(i, f"{['acme shop', 'robert heron', 'rupert', ''][i % 4]}\n{i % 3} North Street 100{i % 2}", "en") for i in range(240)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets = (df.persist() for df in bridge.sides(spark, str(tmp_path)))
    found = candidates.generate(s1, targets, queries.COMPOSED).persist()
    exact, every = ({r.s1_id: ",".join(r.candidate_entity_ids) for r in candidates.nested(df).collect()} for df in (found.where("array_max(map_values(route_scores)) = 1.0"), found))
    want = {(r.entity_id, exact.get(r.entity_id, ""), every.get(r.entity_id, "")) for r in s1.collect()}

    def none(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(candidates, "generate", none)
    assert {tuple(r) for r in queries.QUERIES["er_result_files"](spark, str(tmp_path)).collect()} == want and len(want) == 80


#: Queries over all candidates with their scores or features, from rows of pairs as SCORED has them.
MET = {
    "er_ambiguous": lambda s1, t, found, scored: decide.ambiguous(scored),
    "er_grouped_scores": lambda s1, t, found, scored: model.grouped_scores(scored).select("s1_id", F.array_join("scored.target_id", ","), F.col("scored")[0]["score"], F.element_at("scored", -1)["score"]),
    "er_pair_features": lambda s1, t, found, scored: features.pair_features(found, s1, t).select("s1_id", "target_id", *features.FEATURE_NAMES),
}


def met_texts(n=250):
    names = ["acme shop", "Robert  heron", "rupert heron heron", "Corporation", "été 12", "", "zebra 4711"]
    return [(i, f"{names[i % 7]} word{i // 40}\n{i % 3} North Street 100{i % 2} 1000\nRobert of the word{i // 3} alpha\n{'' if i % 4 else 'same road'}", "en" if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("name", MET)
def test_all_pairs_meet_at_keys(spark, tmp_path, monkeypatch, name):
    from linkloom.operators import meeting
    from linkloom.plans import queries

    spark.createDataFrame(met_texts(), "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets, found, scored = queries._scored(spark, str(tmp_path))
    rows = lambda df: sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    want = rows(MET[name](s1, targets, found, scored))

    def none(*_, **__):
        raise AssertionError("pairs are made")

    for module, f in ((candidates, "generate"), (features, "with_records")):
        monkeypatch.setattr(module, f, none)
    monkeypatch.setattr(meeting, "SHARE", 7)
    monkeypatch.setattr(meeting, "FIRST_LOOK", 55)
    assert rows(queries.QUERIES[name](spark, str(tmp_path))) == want and want


def test_edit_distances_side_by_side():
    import random

    import numpy as np

    from linkloom.operators.meeting import Lanes

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    random.seed(1)
    texts = ["", "a", *("".join(random.choice("abc é") for _ in range(random.randint(0, 90))) for _ in range(40))]
    lanes = Lanes(texts)
    for a in [*texts, "aaaa"]:
        longer = [max(len(a), len(b)) for b in texts]
        want = [0.0 if not a or not b or abs(len(a) - len(b)) / n > text.LENGTH_GATE else 1.0 - distance(a, b) / n for b, n in zip(texts, longer)]
        assert lanes.similar(a, np.ones(len(texts), bool)).tolist() == want


def test_gbt_scores_make_no_rows_of_pairs(spark, tmp_path, monkeypatch):
    from linkloom.plans import queries
    from linkloom.sources import bridge

    fitted = []

    class Constant:
        def fit(self, pairs):
            fitted.append({(r.s1_id, r.target_id): (r.name_edit_similarity, r.addr_token_jaccard) for r in pairs.collect()})
            return self

        def predict_proba(self, pairs):
            return pairs.withColumn("score", F.col("name_edit_similarity"))

    spark.createDataFrame(met_texts(120), "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    every = {(r.s1_id, r.target_id): (r.name_edit_similarity, r.addr_token_jaccard) for r in queries.QUERIES["er_pair_features"](spark, str(tmp_path)).collect()}
    true = pairs(bridge.truth(*queries._sides(spark, str(tmp_path))))

    def none(*_, **__):
        raise AssertionError("pairs are made")

    for module, f in ((candidates, "generate"), (features, "with_records"), (bridge, "truth")):
        monkeypatch.setattr(module, f, none)
    monkeypatch.setattr(model, "baseline_matcher", Constant)
    monkeypatch.setattr(queries, "FIT_ROWS", 50)
    got = {(r.s1_id, r.target_id): (r.label, r.score) for r in queries.QUERIES["er_gbt_scores"](spark, str(tmp_path)).collect()}
    assert got == {p: (float(p in true), x[0]) for p, x in every.items()} and {1.0, 0.0} == {x[0] for x in got.values()}
    assert [len(f) for f in fitted] == [50, 50] and all(every[p] == x for f in fitted for p, x in f.items()) and not fitted[0].keys() & fitted[1].keys()


def test_char_ngram_counts_in_a_grid(spark, monkeypatch):
    from linkloom.operators import ngrams

    def none(*_, **__):
        raise AssertionError("rows of grams are joined")

    monkeypatch.setattr(routes, "capped", none)
    monkeypatch.setattr(ngrams, "SHARE", 10)
    monkeypatch.setattr(ngrams, "BATCH", 5)
    words = ["acme", "acme shop", "shop", "a", "", "zebra store", "store 12", "été"]
    # Ids repeat; the cap is met in the middle of a range and in later ones.
    rows = [(f"S1-{i % 20}", f"{words[i % 8]}", i) for i in range(25)] + [(f"S2-{i % 55}", f"{words[i % 8]} {words[i % 5]}".strip(), 1000 - i) for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id string, name_norm string, ord long")
    s1, targets = df.where("entity_id like 'S1%'"), df.where("entity_id not like 'S1%'")
    for n, least, cap in ((3, 3, 7), (2, 1, 500), (4, 2, 30)):
        grams = lambda w: {f" {w} "[k : k + n] for k in range(max(1, len(w) + 3 - n))} if w else set()  # noqa: E731, B023
        held = {}
        for e, w, o in sorted(rows, key=lambda r: r[2]):
            for g in grams(w) if e.startswith("S2") else ():
                held.setdefault(g, []).append((e, o))
        shared, first = {}, {}
        for e, w, _ in rows:
            for g in grams(w) if e.startswith("S1") else ():
                for t, o in held.get(g, [])[:cap]:
                    shared[e, t] = shared.get((e, t), 0) + 1
                    first[t] = min(o, first.get(t, o))
        want = {(e, t) for (e, t), c in shared.items() if c >= least}
        got = routes.char_ngram(s1, targets, n, least, cap).collect()
        assert want and len(got) == len(want) and {(r.s1_id, r.target_id) for r in got} == want
        assert all(r.ord >= first[r.target_id] and r.route == "char_ngram" for r in got)


def test_tfidf_meets_in_a_grid(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from linkloom.operators import nearest

    for name, value in (("BUCKETS", 64), ("PARTS", 4), ("BLOCK", 10), ("CELLS", 8)):
        monkeypatch.setattr(nearest, name, value)
    random.seed(3)
    # Ids repeat, some vectors are empty, and equal terms and scores are many.
    word = lambda: random.choice(["aa", "bb", "cc", "dd", "ee", "ff", "x", "gg hh", "zz"])
    rows = [(f"S{1 + (i % 3 > 0)}-{i % 50}", " ".join(word() for _ in range(i % 7)).split(), ["st"] * (i % 2), i) for i in range(70)]
    df = spark.createDataFrame(rows, "entity_id string, name_tokens array<string>, address_tokens array<string>, ord long")
    s1, targets = df.where("entity_id like 'S1%'"), df.where("entity_id like 'S2%'")
    counts = {}
    for e, a, b, _ in rows:
        w = [x for x in a + b if len(x) > 1]
        counts.setdefault(e, Counter()).update(w + [" ".join(p) for p in zip(w, w[1:])])
    n = sum(r[0].startswith("S2") for r in rows)
    every = sum((c for e, c in counts.items() if e.startswith("S2")), Counter())
    for most in (12, 500):
        terms = sorted(every, key=lambda t: (-every[t], t))[:most]
        df_of = {t: sum(t in c for e, c in counts.items() if e.startswith("S2")) for t in terms}
        raw = {e: {t: k * (math.log((n + 1) / (df_of[t] + 1)) + 1) for t, k in c.items() if t in df_of} for e, c in counts.items()}
        norm = {e: math.sqrt(sum(x * x for x in v.values())) for e, v in raw.items()}
        score = {(a, b): sum(x * raw[b].get(t, 0) for t, x in raw[a].items()) / norm[a] / norm[b] for a in raw for b in raw if a < b and a[:2] == "S1" and b[:2] == "S2" and norm[a] and norm[b]}
        first = {e: min(r[3] for r in rows if r[0] == e) for e in raw}
        want = {}
        for a in raw:
            own = sorted(((p, x) for p, x in score.items() if p[0] == a and x >= 0.4), key=lambda y: (-round(y[1], 9), first[y[0][1]]))[:5]
            want |= {p: round(x, 6) for p, x in own}
        got = routes.tfidf(s1, targets, 5, 0.4, most).collect()
        assert want and len(got) == len(want) and {(r.s1_id, r.target_id): round(r.score, 6) for r in got} == want


def test_staged_tables_leave_no_shuffle_files(spark):
    import time

    from linkloom.sources.stages import CLEANUP, staged

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before, setting = files(), spark.conf.get(CLEANUP)
    df = staged(spark.range(10_000).withColumn("x", F.col("id") % 7).repartition(5, "x"), "spread")
    end = time.time() + 10
    while (left := {f for f in files() - before if f.startswith("shuffle_")}) and time.time() < end:
        time.sleep(0.2)
    assert not left and df.count() == 10_000 and spark.conf.get(CLEANUP) == setting


def test_rare_pairs_meet_at_the_first_word_alone(spark, tmp_path):
    from linkloom.operators import scoring
    from linkloom.plans import queries

    # Twelve near copies each share all their words but one; a word of all records is too frequent, one is in a single target.
    words = "alder birch cedar ebony"
    texts = [(i, f"{'xyz'[i % 3]}own{i} {words} {'linden' if i < 36 else 'poplar'}", "en") for i in range(72)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets = queries._slim(spark, str(tmp_path), scored=True)
    rows = scoring._rare(s1, targets, 0.3).collect()
    own = {r.ord: set(r.name_norm.split()) for r in s1.unionByName(targets).collect()}
    alike = {(a, b) for a in own for b in own if a // 1_000_000 % 3 == 0 and b // 1_000_000 % 3 and len(own[a] & own[b]) >= 5}
    assert {(r.s1, r.target) for r in rows} >= alike and len(rows) == len({(r.s1, r.target) for r in rows})
    # All four words of all records are in 48 targets: the first is where all meet, and each S1 text goes there once.
    assert {r.key for r in rows} == {"alder"} and len({(r.s1, r.key) for r in rows}) == 24


def test_two_targets_are_compared_once_for_all_records(spark, sides):
    _, t = sides
    found = scored(spark, [(f"S1-{i}", target, 0.9) for i in range(20) for target in ("S2-21", "S3-31", "S2-90")])
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(a):
        looked.add(1)
        return a

    got = evidence.opposite_pairs(found, t, {"names": lambda a, b: F.concat(name(a["name_norm"]), F.lit("|"), b["name_norm"])}).collect()
    assert len(got) == 40 and looked.value == 2
    names = {r.entity_id: r.name_norm for r in t.collect()}
    assert {(r.a.id, r.b.id, r.names) for r in got} == {(a, "S3-31", f"{names[a]}|{names['S3-31']}") for a in ("S2-21", "S2-90")}


def test_violations_make_no_rows_of_equal_names(spark, tmp_path, monkeypatch):
    from linkloom.plans import queries

    # More equal names than the route's cap, an empty one.
    texts = [(i, f"{['acme shop', 'Acme, Shop!', 'zebra', ''][i % 4]}\n{i % 5} north street", "en") for i in range(240)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets = queries._slim(spark, str(tmp_path))
    every = routes.exact_name(s1, targets.withColumn("name_tokens", text.tokens(F.col("name_norm"))))
    want = {r.s1: r.ids for r in every.groupBy(F.col("s1_id").alias("s1")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target_id"))), lambda x: x["target_id"]).alias("ids")).collect()}
    from linkloom.operators import compact

    assert {r.s1: r.ids for r in compact.by_name(s1, targets).collect()} == want and {len(x) for x in want.values()} == {40, 50}

    def none(*_, **__):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(routes, "exact_name", none)
    assert queries.QUERIES["er_violations"](spark, str(tmp_path)).count() > 0


def test_texts_of_plain_and_rare_keys_are_shuffled_one_after_the_other(spark, tmp_path, monkeypatch):
    from linkloom.operators import scoring
    from linkloom.plans import queries

    spark.createDataFrame(met_texts(60), "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    s1, targets = queries._slim(spark, str(tmp_path), scored=True)
    names, stage = [], scoring.staged
    monkeypatch.setattr(scoring, "staged", lambda df, name, *a: names.append((name, "score" in df.columns)) or stage(df, name, *a))
    assert scoring.matches(s1, targets, 0.5, 10).count() > 0
    assert [n for n, of_scores in names if of_scores] == ["plain", "rare"]


def test_gbt_is_fitted_on_all_pairs(spark, tmp_path, monkeypatch):
    from linkloom.operators import meeting
    from linkloom.plans import queries

    fitted, met, made = [], meeting.met, []

    class Constant:
        def fit(self, pairs):
            fitted.append(pairs.select("s1_id", "target_id").collect())
            return self

        def predict_proba(self, pairs):
            return pairs.withColumn("score", F.lit(0.5))

    # 204 S1 records with the 200 targets of equal sound and more of equal numbers: more than 20,000 pairs a half.
    spark.createDataFrame([(i, f"robert {chr(97 + i % 26)}\n12345 road", "en") for i in range(612)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    every = queries.QUERIES["er_candidate_recall"](spark, str(tmp_path)).first().total_candidate_pairs
    monkeypatch.setattr(model, "baseline_matcher", Constant)
    monkeypatch.setattr(meeting, "met", lambda *a, **k: made.append(a) or met(*a, **k))
    got = queries.QUERIES["er_gbt_scores"](spark, str(tmp_path))
    assert got.count() == every == sum(map(len, fitted)) == len({tuple(r) for f in fitted for r in f}) and len(made) == 1
    assert every > 40_000 and min(map(len, fitted)) > 0


def test_features_of_wanted_targets_only_and_once_a_text(monkeypatch):
    import pyarrow as pa

    from linkloom.operators import meeting

    made, asked, init, similar = [], [], meeting.Lanes.__init__, meeting.Lanes.similar
    monkeypatch.setattr(meeting.Lanes, "__init__", lambda self, texts: made.append(list(texts)) or init(self, texts))
    monkeypatch.setattr(meeting.Lanes, "similar", lambda self, a, wanted: asked.append(a) or similar(self, a, wanted))
    pack, _ = meeting._zipper("")
    # Two S1 records of one text; the second target meets both at a smaller key, the third only the one without it.
    rows = [(0, 10, [], "acme store"), (0, 20, [0], "acme shore"), (0, 30, [3], "acme stone"), (1, 1, [0, 3], "acme shop"), (1, 2, [0], "acme shop")]
    batch = pa.RecordBatch.from_pydict({"key": [8] * 5, "share": [0] * 5, "kind": [r[0] for r in rows], "ord": [r[1] for r in rows], "others": [r[2] for r in rows], "blob": [pack(r[3], "", "", "en") for r in rows]})
    want = {(1, 10, 0.7), (2, 10, 0.7), (2, 30, 0.7)}
    for waiting in (meeting.ASKING, 1):
        monkeypatch.setattr(meeting, "ASKING", waiting)
        got = [r for b in meeting._meet("", meeting.FEATURES, False, False, None)([batch]) for r in b.to_pylist()]
        assert {(r["s1"], r["target"], r["name_edit_similarity"]) for r in got} == want and len(got) == 3
        grams = {10: 5 / 14, 30: 5 / 14}
        assert all(abs(r["name_char_ngram_similarity"] - grams[r["target"]]) < 1e-12 for r in got)
        if waiting > 1:
            assert [t for t in made if "acme store" in t] == [["acme store", "acme stone"]] and asked.count("acme shop") == 2
