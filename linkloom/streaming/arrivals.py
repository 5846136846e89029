"""Streaming arrivals of S1 records against static targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import routes
from linkloom.operators.records import normalize


def postings(targets: DataFrame, cap: int = 50) -> DataFrame:
    """(key, target_id, ord) of normalised targets under their names and addresses, capped like the batch routes; stage it once for all micro-batches."""
    keys = F.array_compact(F.array(F.when(F.col("name_norm") != "", F.concat(F.lit("n:"), "name_norm")), F.when(F.col("address_norm") != "", F.concat(F.lit("a:"), "address_norm"))))
    return routes.capped(routes.keyed(targets, keys, "target_id"), ["key"], cap)


def match_arrivals(stream: DataFrame, static_postings: DataFrame) -> DataFrame:
    """Candidate pairs of a stream of source records (raw columns and ord): a stateless stream-static join."""
    s1 = normalize(stream, store_raw=False)
    keys = F.array_compact(F.array(F.when(F.col("name_norm") != "", F.concat(F.lit("n:"), "name_norm")), F.when(F.col("address_norm") != "", F.concat(F.lit("a:"), "address_norm"))))
    asked = s1.select(F.col("entity_id").alias("s1_id"), F.explode(keys).alias("key"))
    route = F.when(F.col("key").startswith("n:"), "exact_name").otherwise("exact_address")
    return asked.join(static_postings, "key").select("s1_id", "target_id", route.alias("route"), "ord")


def write_arrivals(pairs: DataFrame, folder: str, checkpoint: str):
    """Appends the pairs of each micro-batch as Parquet, exactly once, until what is there has been read."""
    return pairs.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
