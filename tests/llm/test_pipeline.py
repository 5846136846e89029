"""The corpus pipeline, each stage against plain code for what it must do with its own input."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, plain_components, plain_fingerprint, plain_pii, plain_quality, plain_targets

import corpus_pipeline
from linkloom.llm import op1_quality, op7_packing, op8_tokens
from linkloom.llm.tables import stage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, d string, pii string, fp int"


def prose(seed, words=80):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(words))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated ids, equal rows, copies, personal data, repetition, and names that clash with inner ones."""
    texts = [(None, None), (1, None), (1, ""), (2, prose(1)), (2, prose(2)), (None, prose(3)), (None, prose(4)), (None, prose(4)), (5, prose(5)), (5, prose(5)), (6, prose(5)), (7, prose(6) + " mail a.b@c.example.org now"), (8, prose(7) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (9, "spam again " * 60), (10, prose(8, 6000)), (11, prose(8, 6000)), (12, "few words")]
    rows = [(k, t, None if i % 5 == 0 else "en", [None, "a", "b"][i % 3], None if i % 4 == 0 else len(t or ""), i, "clash", "clash", 1) for i, (k, t) in enumerate(texts)]
    return stage(spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA), "odd")


def plain_kept(text):
    m = plain_quality(text)
    if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
        return False
    chars = sum(map(len, (text or "").split("\n")))
    return 100 * m["dup_line_chars"] <= 30 * chars and all(100 * m[f"dup_chars_{n}"] <= p * m["word_chars"] for n, p in op1_quality.GRAM_LIMITS.items())


def records(df):
    return [tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()]


def check(spark, docs):
    from tokenizers import Tokenizer

    def one(name):
        out = stage(dict(corpus_pipeline.STAGES)[name](spark, docs, SF), name)
        assert out.columns == corpus_pipeline.COLUMNS
        return records(docs), records(out), out

    before, after, docs = one("quality")
    assert Counter(after) == Counter(r for r in before if plain_kept(r[1]))

    before, after, docs = one("near_dedup")
    of = plain_components({i: plain_fingerprint(r[1]) for i, r in enumerate(before)})
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[of[i]].append(r)
    assert len(after) == len(groups) and not Counter(after) - Counter(before)
    least = Counter(min((r[0] is None, r[0]) if r[0] is not None else (True, 0) for r in g) for g in groups.values())
    assert Counter((r[0] is None, r[0] or 0) for r in after) == least

    before, after, docs = one("pii")
    assert len(before) == len(after) and all(r[4] is None if r[1] is None else r[4] == len(r[1]) for r in after)
    plain = Counter()
    for r in before:
        spans = [tuple(map(int, x.split(":")[1:])) for x in plain_pii(r[1])]
        if not spans and not re.search("(?i)token|password", r[1] or ""):
            plain[r[1]] += 1  # nothing in it: stays as it is
    assert not plain - Counter(r[1] for r in after)
    assert not [r for r in after if plain_pii(r[1]) or re.search("[0-9a-f]{40}", r[1] or "")]

    before, after, docs = one("mixing")
    size = Counter()
    for r in before:
        size[r[3]] += len(WORDS(r[1] or ""))
    want, taken, copies = plain_targets(dict(size)), Counter(), Counter(after)
    for r in after:
        taken[r[3]] += len(WORDS(r[1] or ""))
    largest = max((len(WORDS(r[1] or "")) for r in before), default=0)
    assert set(copies) <= set(before) and all(n <= 3 * Counter(before)[r] for r, n in copies.items())
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in size) and sum(taken.values()) <= sum(size.values())

    library = Tokenizer.from_file(op8_tokens.vocabulary(op7_packing.VOCABULARY))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed)))
    got = Counter((r.doc_id, r.start, r.length, r.ids) for r in packed)
    pieces = Counter()
    for r in after:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        start = 0
        for n in op7_packing.pieces(len(ids)):
            pieces[r[0], start, n, b"".join(i.to_bytes(4, "little") for i in ids[start : start + n])] += 1
            start += n
    assert got == pieces


def test_stages_on_odd_rows(spark, odd):
    check(spark, odd)


def test_stages_on_the_table(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_null_rows_stay_as_many(spark):
    df = spark.createDataFrame([(None, prose(i), None, None, None) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES[:-1]:
        df = stage(step(spark, df, SF), name)
        assert df.count() == 20 and df.select("text").distinct().count() == 20, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).agg(F.sum("length")).first()[0] > 20 * 80


def test_empty_table(spark, odd):
    df = odd.limit(0)
    for name, step in corpus_pipeline.STAGES:
        df = stage(step(spark, df, SF), name)
        assert df.count() == 0


def test_run(spark):
    assert {"doc_id", "start", "length", "sequence_id"} <= set(corpus_pipeline.run(spark, SF).columns)
