"""Normalised records: one projection that all later operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text


def normalize(df: DataFrame, store_raw: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Records with normal forms, tokens, numeric anchors and the missing-address flag; columns nobody reads are pruned."""
    ids = [F.trim(F.coalesce("entity_id", F.lit(""))).alias("entity_id"), F.trim(F.coalesce("country", F.lit(""))).alias("country")]
    raw = ["business_name", "business_address"] if store_raw else []
    first = df.select("ord", *ids, *raw, *(keep or []), text.business_name(F.col("business_name")).alias("name_norm"), text.address(F.col("business_address")).alias("address_norm"), text.numeric_anchors(F.col("business_address")).alias("numeric_anchors"))
    return first.select("*", text.tokens(F.col("name_norm")).alias("name_tokens"), text.tokens(F.col("address_norm")).alias("address_tokens"), (F.trim("address_norm") == "").alias("is_address_missing"))
