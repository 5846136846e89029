"""The n-gram route without a row per gram of a pair: grams that targets hold within the cap are told by ranges of the
scan order, and shared grams are counted in a grid of blocks of targets and shares of S1 records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import text
from linkloom.sources.stages import staged

#: Ranges of the scan order, at most.
RANGES = 64
#: Blocks of targets: S1 records go to each.
BLOCKS = 8
#: S1 records of a share: targets go to each.
SHARE = 1 << 17
#: Pairs of a batch that leaves a task, more or less.
BATCH = 100_000


def grams(name: str, n: int) -> set[str]:
    """text.char_ngrams of a lower-cased name without spare white space."""
    padded = f" {name} "
    if not name:
        return set()
    return {padded[i : i + n] for i in range(len(padded) - n + 1)} or {padded}


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, dict[str, int]] = {}
        for b in batches:
            for part, name in zip(b.column("part").to_pylist(), b.column("name").to_pylist()):
                own = counts.setdefault(part, {})
                for g in grams(name, n):
                    own[g] = own.get(g, 0) + 1
        for part, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array(list(own)), pa.array(list(own.values()), pa.int64())], ["part", "gram", "n"])

    return run


def _kept(n: int):
    """Of quotas and, after them, targets in scan order of each range: the grams that each target holds within the cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, {}
        for b in batches:
            rows = []
            for part, kind, order, name, quota, entity in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "ord", "name", "quota", "entity_id"))):
                if part != at:
                    at, left = part, {}
                if kind == 0:
                    left[name] = quota
                    continue
                own = []
                for g in grams(name, n):
                    if (q := left.get(g)) is not None:
                        own.append(g)
                        if q == 1:
                            del left[g]
                        else:
                            left[g] = q - 1
                if own:
                    rows.append((entity, order, "\n".join(own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["entity_id", "ord", "name"])

    return run


class _Block:
    """Targets of a block and which of them hold a gram."""

    def __init__(self) -> None:
        self.places, self.ids, self.ords, self.vocabulary, self.of_gram, self.of_target = {}, [], [], {}, [], []
        self.ready = False

    def add(self, entity: str, order: int, joined: str) -> None:
        j = self.places.setdefault(entity, len(self.places))
        if j == len(self.ids):
            self.ids.append(entity), self.ords.append(order)
        self.ords[j] = min(self.ords[j], order)
        own = joined.split("\n")
        self.of_gram.extend(self.vocabulary.setdefault(g, len(self.vocabulary)) for g in own)
        self.of_target.append((j, len(own)))

    def close(self) -> None:
        at = np.array(self.of_gram, np.int32)
        targets = np.repeat(*(np.array(c, np.int32) for c in zip(*self.of_target)))
        self.postings = targets[np.argsort(at, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.vocabulary)))])
        self.entities, self.order, self.of_gram, self.of_target, self.ready = pa.array(self.ids, pa.string()), np.array(self.ords, np.int64), [], [], True

    def shared(self, own: list[str], least: int) -> np.ndarray:
        """Places of the targets that hold at least so many of these grams."""
        at = [i for g in own if (i := self.vocabulary.get(g)) is not None]
        if len(at) < 1:
            return np.empty(0, np.int64)
        found = np.concatenate([self.postings[a:b] for a, b in zip(self.ends[at].tolist(), self.ends[np.array(at) + 1].tolist())])
        return np.flatnonzero(np.bincount(found, minlength=len(self.ids)) >= max(least, 1))


def _met(n: int, least: int):
    def batch(block: _Block, rows: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        places = np.concatenate([r[1] for r in rows])
        s1 = pa.array([r[0] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])))
        return pa.RecordBatch.from_arrays([s1, block.entities.take(pa.array(places)), pa.array(block.order[places])], ["s1_id", "target_id", "ord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, rows, size, entity, own = None, None, [], 0, None, []

        def ask() -> None:
            nonlocal size
            if entity is not None and len(found := block.shared(own, least)):
                rows.append((entity, found))
                size += len(found)

        for b in batches:
            for key, share, kind, name, order, who in zip(*(b.column(c).to_pylist() for c in ("block", "share", "kind", "name", "ord", "entity_id"))):
                if (key, share) != at:
                    if block is not None and block.ready:
                        ask()
                        if rows:
                            yield batch(block, rows)
                    at, block, rows, size, entity, own = (key, share), _Block(), [], 0, None, []
                if kind == 0:
                    block.add(who, order, name)
                    continue
                if not block.ids:
                    continue
                if not block.ready:
                    block.close()
                if who != entity:
                    ask()
                    entity, own = who, []
                    if size >= BATCH:
                        yield batch(block, rows)
                        rows, size = [], 0
                # Records that repeat an id are one with the grams of all.
                own += grams(name, n)
        if block is not None and block.ready:
            ask()
            if rows:
                yield batch(block, rows)

    return run


def pairs(s1: DataFrame, targets: DataFrame, n: int, least: int, cap: int) -> DataFrame:
    """s1_id, target_id and ord of the pairs that share at least `least` n-grams of the name, each held by the first `cap` targets that have it."""
    tasks = int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.when(F.col("name_norm") != "", F.lower(text.squeeze(F.col("name_norm")))).alias("name")
    asked = s1.select("entity_id", name).where("name <> ''")
    ranges = targets.select("entity_id", "ord", name).where("name <> ''").repartitionByRange(min(tasks, RANGES), "ord")
    held = staged(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    counts = held.select("part", "name").mapInArrow(_counted(n), "part int, gram string, n long").groupBy("part", "gram").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("gram").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = counts.withColumn("quota", F.lit(cap) - before).where(F.col("quota") > 0)
    both = quotas.select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), F.col("gram").alias("name"), "quota", F.lit("").alias("entity_id")).unionByName(
        held.select("part", F.lit(1).alias("kind"), "ord", "name", F.lit(0).cast("long").alias("quota"), "entity_id")
    )
    kept = both.repartition(tasks, "part").sortWithinPartitions("part", "kind", "ord").mapInArrow(_kept(n), "entity_id string, ord long, name string")
    shares = max(1, -(-asked.count() // SHARE))
    of = lambda m: F.pmod(F.xxhash64("entity_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.array(*map(F.lit, range(m))))
    postings = kept.select(of(BLOCKS).alias("block"), every(shares).alias("share"), F.lit(0).alias("kind"), "name", "ord", "entity_id")
    wanted = asked.select(every(BLOCKS).alias("block"), of(shares).alias("share"), F.lit(1).alias("kind"), "name", F.lit(0).cast("long").alias("ord"), "entity_id")
    cells = postings.unionByName(wanted).repartitionById(BLOCKS * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions("block", "share", "kind", "entity_id")
    return cells.mapInArrow(_met(n, least), "s1_id string, target_id string, ord long")
