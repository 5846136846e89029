"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are computed in numpy over the word numbers of each text.
Windows whose hash occurs again mark their words, and the characters (code points) of marked words are
compared with a limit for each length; so are the characters of lines that repeat an earlier line.

Defined results: a null or empty text has no words and counts of 0 and fails the base rule.  Texts of
any length are measured whole; a batch is measured text by text.  Rows are independent, so ties,
repeated rows and empty tables need no rule.  An input column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tables import WORD, read, small_batches

#: Percent of a text's word characters that may lie in repeated windows, by words in the window.
GRAM_LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Percent of a text's characters that may lie in lines equal to an earlier one.
LINE_LIMIT = 30
#: Base rule: fewest words, and most percent of words in repeated windows of three words.
LEAST_WORDS, REPEAT_LIMIT = 50, 50

_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars", *(f"dup_chars_{n}" for n in GRAM_LIMITS))
_words, _symbols = re.compile(WORD).findall, re.compile(r"[#*$%&|<>]").findall
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _values(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word number (a bijection, so different words differ)."""
    x = ids.astype(np.uint64) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _covered(keys: np.ndarray, n: int, words: int) -> np.ndarray | None:
    """Which words lie in a window whose key occurs twice or more; None if no key does."""
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return None
    again = again[np.r_[True, again[1:] != again[:-1]]]
    at = np.searchsorted(again, keys)
    starts = np.flatnonzero(again[np.minimum(at, len(again) - 1)] == keys)
    step = np.zeros(words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def _exact_threes(ids: np.ndarray) -> np.ndarray:
    """A number for each window of three words, equal only for equal windows."""
    if ids.max() < 1 << 21:
        return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    _, pairs = np.unique((ids[:-1] << 31) | ids[1:], return_inverse=True)
    return (pairs[:-1].astype(np.int64) << 31) | ids[2:]


def measure(text: str | None, number: defaultdict) -> tuple[int, ...]:
    """The counts of _FIELDS for one text; number gives each word of a batch its own number."""
    text = text or ""
    words = _words(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: set[str] = set()
    line_chars = dup_chars = dup_lines = 0
    for line in text.split("\n"):
        line_chars += len(line)
        if line in seen:
            if _words(line):
                dup_lines += 1
                dup_chars += len(line)
        else:
            seen.add(line)
    grams = dict.fromkeys(GRAM_LIMITS, 0)
    repeat = 0
    if n > 3:
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        threes = _covered(_exact_threes(ids), 3, n)
        if threes is not None:  # without a repeated window of three words no longer one repeats
            repeat = int(threes.sum())
            values = _values(ids)
            rolling = values[:-2] * _MULTIPLIER * _MULTIPLIER + values[1:-1] * _MULTIPLIER + values[2:]
            for k in range(4, max(GRAM_LIMITS) + 1):
                if k > n:
                    break
                rolling = rolling[:-1] * _MULTIPLIER + values[k - 1 :]
                if k in grams:
                    hit = _covered(rolling, k, n)
                    if hit is None:
                        break
                    grams[k] = int(lengths[hit].sum())
    return (n, int(lengths.sum()), len(_symbols(text)), dup_lines, repeat, line_chars, dup_chars, *grams.values())


def _measured(texts: pa.Array) -> pa.Array:
    number = defaultdict(count().__next__)
    rows = [measure(x.as_py(), number) for x in texts]
    columns = np.array(rows, np.int64).reshape(len(rows), len(_FIELDS)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(_FIELDS))


def score(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a struct column `out`: the counts, base_failed and kept."""
    small_batches(docs.sparkSession)
    kind = "struct<" + ",".join(f"{f}:bigint" for f in _FIELDS) + ">"
    once = F.arrow_udf(_measured, kind).asNondeterministic()  # else a filter on the result is pushed below and measures every text twice
    m = F.col(out)
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_LIMIT * m["n_words"])
    bad = 100 * m["dup_line_chars"] > LINE_LIMIT * m["line_chars"]
    for n, limit in GRAM_LIMITS.items():
        bad = bad | (100 * m[f"dup_chars_{n}"] > limit * m["word_chars"])
    return docs.withColumn(out, once(text)).withColumn(out, F.struct(f"{out}.*", base.alias("base_failed"), (~base & ~bad).alias("kept")))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return score(docs, text, "__quality").where("__quality.kept").drop("__quality")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in GRAM_LIMITS), "base_failed", "kept"]
    return score(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(f"quality.{c}" for c in counts))


def _grams_sql() -> str:
    lengths = [3, *GRAM_LIMITS]
    gram = lambda n: " || ' ' || ".join(f"lead(word, {k}) OVER p" if k else "word" for k in range(n))
    return f"""
, g AS (SELECT doc_id, pos, word, {", ".join(f"{gram(n)} AS g{n}" for n in lengths)} FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos))
, r AS (SELECT doc_id, pos, word, {", ".join(f"(g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1)::int AS r{n}" for n in lengths)} FROM g)
, c AS (SELECT doc_id, word, {", ".join(f"max(r{n}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)} FROM r)
, s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(c3) AS n_repeat_words, {", ".join(f"sum(c{n} * length(word)) AS dup_chars_{n}" for n in GRAM_LIMITS)} FROM c GROUP BY doc_id)"""


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
, x AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)
, w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM x)
{_grams_sql()}
, l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
, l1 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') AS again FROM l0)
, l AS (SELECT doc_id, sum(length(line)) AS line_chars, sum(again::int) AS n_dup_lines, sum(again::int * length(line)) AS dup_line_chars FROM l1 GROUP BY doc_id)
, m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars
    , length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines
    , coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, dup_line_chars::BIGINT AS dup_line_chars, line_chars
    , {", ".join(f"coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}" for n in GRAM_LIMITS)}
    FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id))
, v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM m)
SELECT * EXCLUDE (line_chars), NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * line_chars
    AND {" AND ".join(f"100 * dup_chars_{n} <= {p} * word_chars" for n, p in GRAM_LIMITS.items())} AS kept FROM v
"""
