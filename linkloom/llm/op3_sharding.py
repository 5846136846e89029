"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group and stay together.  Groups go, largest first, to the least-loaded
shard, held in a heap.  Groups of equal size are interchangeable, so the schedule is computed from the
table of sizes and their counts alone: how many groups of a size each shard takes.  That table has at
most sqrt(2 x all bytes) rows, since different sizes add up; it streams through one task, whose state
is the heap.  Each group then finds its shard by its rank among the groups of its size.

Equal groups of one size are filled in together once there are more of them than ONE_BY_ONE, by a
search for the load that the heap would reach; the outcome is the heap's own.

Defined results: a null text has no bytes (size 1) and groups with the empty one.  Repeated rows are
rows of a group.  Ties between shards go to the lower number; groups of a size are ranked by a hash of
their text.  An empty table gives an empty result.  Texts are only hashed and measured, whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tables import lookup, ranked, read, stage

SHARDS = 8
ONE_BY_ONE = 64


def fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each shard takes, least-loaded first, ties to the lower number."""
    took = [0] * len(loads)
    if count <= ONE_BY_ONE:
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, i = heap[0]
            took[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        return took
    # The heap takes the (load, shard) pairs load + j * size in ascending order; find the level that has them all.
    at = np.array(loads, dtype=object)
    below = lambda level: sum(max(0, -((x - level) // size)) for x in at)  # noqa: E731  entries under the level
    low, high = min(loads), max(loads) + size * (count + 1)
    while low + 1 < high:  # the highest level with at most `count` entries under it
        mid = (low + high) // 2
        low, high = (mid, high) if below(mid) <= count else (low, mid)
    took = [max(0, -((x - low) // size)) for x in loads]
    rest = count - sum(took)
    for i, x in enumerate(loads):  # entries at the level itself, by shard number
        if rest and x + took[i] * size == low:
            took[i] += 1
            rest -= 1
    return took


def _scheduler(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * shards
        for batch in batches:
            out = []
            for size, count in zip(batch["group_size"].tolist(), batch["n"].tolist(), strict=True):
                first = 0
                for shard, n in enumerate(fill(loads, size, count)):
                    if n:
                        out.append((size, first, first + n, shard))
                        first += n
                        loads[shard] += n * size
            yield pd.DataFrame(out, columns=["group_size", "first", "end", "shard"])

    return run


def assign(rows: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = rows.select(F.col(key).alias("k"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("g"))
    base = stage(base, "rows")
    groups = stage(base.groupBy("g").agg(F.sum("size").alias("group_size")), "groups")
    counts = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.repartition(1).sortWithinPartitions(F.desc("group_size")).mapInPandas(_scheduler(shards), "group_size long, first long, end long, shard int")
    # At most `shards` rows a size: what a size's groups meet in this join is that short list.
    plan = plan.groupBy("group_size").agg(F.collect_list(F.struct("first", "end", "shard")).alias("runs"))
    placed = ranked(groups, ["group_size"], [F.col("g")], "nth", buckets=256).join(plan, "group_size")
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("nth")) & (F.col("nth") < r["end"])), 1)
    placed = stage(placed.select("g", run["shard"].alias("shard")), "placed")
    found = stage(lookup(base, placed, "g").select("k", "size", "text_crc32", "shard"), "found")
    out = ranked(found, ["shard"], [F.col("k"), F.col("text_crc32"), F.col("size")], "slot", bucket=F.pmod(F.xxhash64("k", "text_crc32"), F.lit(512)))
    return out.select(F.col("k").alias(key), "size", "text_crc32", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
