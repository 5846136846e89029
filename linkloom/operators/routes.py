"""Candidate routes: equi-joins of S1 records with targets on derived keys.

A route is a function of two DataFrames of normalised records that gives s1_id, target_id, route, score
and ord (the target's).  Targets of a key are capped by scan order where a route has a cap: it bounds
what a frequent key can produce, and Spark plans it as a group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import text
from linkloom.operators import nearest, ngrams

Route = Callable[[DataFrame, DataFrame], DataFrame]
#: The rank of routes, which orders ties.
ROUTES = ["exact_name", "exact_address", "exact_name_address", "numeric_anchors", "rare_tokens", "phonetic", "char_ngram", "tfidf"]


def capped(keys: DataFrame, by: list[str], cap: int) -> DataFrame:
    """The first `cap` postings of each key, by scan order and place in the record."""
    w = W.partitionBy(*by).orderBy("ord", "pos")
    return keys.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n", "pos")


def keyed(df: DataFrame, keys: Column, id_name: str) -> DataFrame:
    """A row per key of a record, in order, repeats included."""
    return df.select(F.col("entity_id").alias(id_name), "ord", F.posexplode(keys).alias("pos", "key"))


def _pairs(s1: DataFrame, postings: DataFrame, by: list[str], route: str, score: float) -> DataFrame:
    """Distinct pairs of the join on a key."""
    joined = s1.join(postings, by).groupBy("s1_id", "target_id").agg(F.min("ord").alias("ord"))
    return joined.select("s1_id", "target_id", F.lit(route).alias("route"), F.lit(score).alias("score"), "ord")


def _by_key(s1: DataFrame, targets: DataFrame, keys: Column, cap: int, route: str, score: float) -> DataFrame:
    postings = capped(keyed(targets, keys, "target_id"), ["key"], cap)
    return _pairs(keyed(s1, keys, "s1_id").select("s1_id", "key").distinct(), postings, ["key"], route, score)


def _one(key: Column, country_partition: bool) -> Column:
    """The key in an array, none if empty; with the country before it where there is one."""
    full = F.when(F.col("country") != "", F.concat("country", F.lit("::"), key)).otherwise(key) if country_partition else key
    return F.when(key != "", F.array(full)).otherwise(F.array().cast("array<string>"))


def exact_name(s1: DataFrame, targets: DataFrame, country_partition: bool = False, max_candidates_per_key: int = 50) -> DataFrame:
    return _by_key(s1, targets, _one(F.col("name_norm"), country_partition), max_candidates_per_key, "exact_name", 1.0)


def exact_address(s1: DataFrame, targets: DataFrame, country_partition: bool = False, max_candidates_per_key: int = 50) -> DataFrame:
    return _by_key(s1, targets, _one(F.col("address_norm"), country_partition), max_candidates_per_key, "exact_address", 1.0)


def exact_name_and_address(s1: DataFrame, targets: DataFrame, max_candidates_per_key: int = 50) -> DataFrame:
    both = (F.col("name_norm") != "") & (F.col("address_norm") != "")
    key = ["name_norm", "address_norm"]
    postings = capped(targets.where(both).select(F.col("entity_id").alias("target_id"), "ord", F.lit(0).alias("pos"), *key), key, max_candidates_per_key)
    return _pairs(s1.where(both).select(F.col("entity_id").alias("s1_id"), *key), postings, key, "exact_name_address", 1.0)


def numeric_keys(country_partition: bool = False) -> Column:
    """Each number of three digits or more, alone and after the first four characters of the name."""
    name4 = F.when(F.length("name_norm") >= 4, F.substring("name_norm", 1, 4))
    before = F.when(F.col("country") != "", F.concat("country", F.lit("::"))).otherwise("") if country_partition else F.lit("")
    long = F.filter("numeric_anchors", lambda n: F.length(n) >= 3)
    return F.flatten(F.transform(long, lambda n: F.filter(F.array(F.concat(before, name4, F.lit("#"), n), F.concat(before, F.lit("NUM_"), n)), lambda k: k.isNotNull())))


def numeric_anchors(s1: DataFrame, targets: DataFrame, max_candidates_per_key: int = 100, country_partition: bool = False) -> DataFrame:
    return _by_key(s1, targets, numeric_keys(country_partition), max_candidates_per_key, "numeric_anchors", 0.9)


def char_ngram(s1: DataFrame, targets: DataFrame, n: int = 3, min_overlap: int = 3, max_candidates_per_key: int = 500) -> DataFrame:
    """Pairs that share at least min_overlap of the indexed n-grams of the name."""
    found = ngrams.pairs(s1, targets, n, min_overlap, max_candidates_per_key)
    return found.select("s1_id", "target_id", F.lit("char_ngram").alias("route"), F.lit(0.7).alias("score"), "ord")


def phonetic_key(tokens: Column) -> Column:
    first = F.coalesce(F.get(F.filter(tokens, lambda t: F.length(t) >= 3), F.lit(0)), F.get(tokens, F.lit(0)), F.lit(""))
    return text.soundex(first)


def phonetic(s1: DataFrame, targets: DataFrame, max_candidates_per_key: int = 200) -> DataFrame:
    return _by_key(s1, targets, _one(phonetic_key(F.col("name_tokens")), False), max_candidates_per_key, "phonetic", 0.6)


def fits_rare(t: Column) -> Column:
    return (F.length(t) >= 4) & ~t.rlike(r"^\p{Nd}+$")


def rare_tokens(s1: DataFrame, targets: DataFrame, min_doc_freq: int = 2, max_doc_freq: int = 50, max_candidates: int = 50, count_repeats: bool = False) -> DataFrame:
    """Postings of tokens of 4 characters or more, not all digits, that min to max targets hold.

    A record takes its tokens in order and adds whole postings until it has max_candidates, so it may
    end with almost twice as many; a token that a record repeats takes two places of its posting, and
    with count_repeats also counts twice for the limits.
    """
    words = keyed(targets, F.filter("name_tokens", fits_rare), "target_id")
    rare = words.groupBy("key").agg((F.count(F.lit(1)) if count_repeats else F.countDistinct("target_id")).alias("df")).where(F.col("df").between(min_doc_freq, max_doc_freq)).select("key")
    postings = capped(words.join(rare, "key"), ["key"], max_candidates)
    # Postings go by scan order, a number that names the target: numbers are united by hashing, structs one against all.
    lists = postings.groupBy("key").agg(F.array_sort(F.collect_list("ord")).alias("posting"))
    # A token that the S1 record repeats can add nothing a second time.
    tokens = F.array_distinct(F.filter("name_tokens", fits_rare))
    asked = keyed(s1, tokens, "s1_id").join(lists, "key").groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("pos", "posting"))).alias("lists"))
    none = F.array().cast("array<bigint>")
    folded = F.aggregate("lists", none, lambda acc, x: F.when(F.size(acc) >= max_candidates, acc).otherwise(F.array_union(acc, x["posting"])))
    return asked.select("s1_id", F.explode(folded).alias("ord")).join(targets.select("ord", F.col("entity_id").alias("target_id")), "ord").select("s1_id", "target_id", F.lit("rare_tokens").alias("route"), F.lit(0.8).alias("score"), "ord")


def rare_tokens_by_occurrence(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The rare-token rule of an index built in one pass: a token counts where it occurs 2 to 25 times in all, repeats included."""
    return rare_tokens(s1, targets, 2, 25, count_repeats=True)


def tfidf(s1: DataFrame, targets: DataFrame, top_k: int = 15, threshold: float = 0.4, max_features: int = 50_000, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """The top_k targets of each S1 record by cosine of smoothed TF-IDF vectors, at least `threshold`.

    Terms are ordered from rare to frequent.  Products are summed over the terms before the rest of either vector has a
    norm under a share of the threshold; what is left out is at most the larger of both rests, so only pairs that may reach
    the threshold with it get their exact cosine.
    """
    found = nearest.nearest(s1, targets, top_k, threshold, max_features, ngram_range)
    w = W.partitionBy("s1_id").orderBy(F.desc(F.round("score", 9)), "ord")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k).select("s1_id", "target_id", F.lit("tfidf").alias("route"), "score", "ord")


BY_NAME: dict[str, Route] = {
    "exact_name": exact_name,
    "exact_address": exact_address,
    "exact_name_address": exact_name_and_address,
    "numeric_anchors": numeric_anchors,
    "rare_tokens": rare_tokens,
    "phonetic": phonetic,
    "char_ngram": char_ngram,
    "tfidf": tfidf,
}
