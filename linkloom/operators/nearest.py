"""The TF-IDF route without a row per term of a pair: vectors of term numbers meet in a grid of blocks of targets and
shares of S1 records, where a record's products are summed over the postings of the terms that matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.stages import staged

#: Terms are first counted in so many buckets, which go to the driver as a number each; in parts.
BUCKETS, PARTS = 1 << 22, 64
#: Targets of a block.
BLOCK = 1 << 17
#: Terms are summed until the rest of a vector has a norm under this share of the threshold.
LEAD = 0.65
#: Cells of the grid that a small table is dealt over.
CELLS = 24


def terms(joined: str, sizes: range) -> Iterator[str]:
    """Word n-grams of each line."""
    for line in joined.split("\n"):
        words = line.split(" ") if line else []
        for n in sizes:
            if n == 1:
                yield from words
            else:
                yield from map(" ".join, zip(*(words[i:] for i in range(n))))


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % buckets


def texts(df: DataFrame) -> DataFrame:
    """entity_id, ord (the first) and text, the words of two characters or more; a line for each record that repeats an id."""
    words = F.array_join(F.filter(F.concat("name_tokens", "address_tokens"), lambda t: F.length(t) >= 2), " ")
    rows = staged(df.select("entity_id", "ord", words.alias("text")), "texts")
    often = staged(rows.groupBy("entity_id").count().where("count > 1").select("entity_id"), "often")
    if often.isEmpty():
        return rows
    again = rows.join(often, "entity_id").groupBy("entity_id").agg(F.min("ord").alias("ord"), F.array_join(F.collect_list("text"), "\n").alias("text"))
    return rows.join(often, "entity_id", "left_anti").unionByName(again)


def vocabulary(rows: DataFrame, sizes: range, most: int) -> list[tuple[str, int]]:
    """(term, number of rows with it) of the `most` terms that occur most often, ties by term; from rare to frequent.

    A bucket holds all of a term, so where the last of them has as many as the least bucket looked into, none is missed.
    """
    buckets, parts = BUCKETS, PARTS
    part = buckets // parts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for joined in b.column("text").to_pylist():
                for t in terms(joined, sizes):
                    sums[_bucket(t, buckets)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([zlib.compress(sums[i * part : (i + 1) * part].tobytes(), 1) for i in range(parts)])], ["part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, blob in zip(b.column("part").to_pylist(), b.column("sums").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(blob), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    found = rows.select("text").mapInArrow(counted, schema).repartition(parts, "part").mapInArrow(added, schema).collect()
    sums = np.zeros(buckets, np.int64)
    for r in found:
        sums[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(zlib.decompress(r["sums"]), np.int64)
    wanted = 2 * most
    while True:
        least = max(1, int(np.partition(sums, buckets - wanted)[buckets - wanted])) if wanted < buckets else 1
        looked = np.packbits(sums >= least, bitorder="little").tobytes()

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.unpackbits(np.frombuffer(looked, np.uint8), bitorder="little").tobytes()  # noqa: B023
            every, each = Counter(), Counter()
            for b in batches:
                for joined in b.column("text").to_pylist():
                    own = [t for t in terms(joined, sizes) if flags[_bucket(t, buckets)]]
                    every.update(own)
                    each.update(set(own))
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([each[t] for t in every], pa.int64())], ["term", "n", "df"])

        counts = rows.select("text").mapInArrow(exact, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        top = counts.orderBy(F.desc("n"), "term").limit(most).collect()
        if least == 1 or len(top) == most and top[-1]["n"] >= least:
            return sorted(((r["term"], r["df"]) for r in top), key=lambda x: (x[1], x[0]))
        wanted *= 4


def _vectors(rows: DataFrame, numbers: dict[str, int], sizes: range) -> DataFrame:
    """entity_id, ord and vector: the numbers of a row's terms in order, as often as they occur."""
    shared = rows.sparkSession.sparkContext.broadcast(list(numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {t: i for i, t in enumerate(shared.value)}
        kind = np.uint16 if len(of) <= 1 << 16 else np.uint32
        for b in batches:
            found = [np.sort(np.array([i for t in terms(x, sizes) if (i := of.get(t)) is not None], kind)).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("entity_id"), b.column("ord"), pa.array(found, pa.binary())], ["entity_id", "ord", "vector"])

    return rows.select("entity_id", "ord", "text").mapInArrow(run, "entity_id string, ord long, vector binary").where("length(vector) > 0")


class _Block:
    def __init__(self, idf: np.ndarray, threshold: float) -> None:
        self.idf, self.threshold, self.kind = idf, threshold, np.uint16 if len(idf) <= 1 << 16 else np.uint32
        self.ids, self.ords, self.blobs, self.ready = [], [], [], False
        self.dense = np.zeros(len(idf))

    def weighed(self, blob: bytes) -> tuple[np.ndarray, np.ndarray, int, float]:
        """Terms, weights, how many of the first terms lead and the norm of the rest; the rest has a norm under LEAD of the threshold."""
        at, n = np.unique(np.frombuffer(blob, self.kind), return_counts=True)
        raw = n * self.idf[at]
        weights = raw / np.sqrt((raw * raw).sum())
        rest = np.sqrt(np.cumsum((weights * weights)[::-1])[::-1])
        lead = int(np.count_nonzero(rest >= self.threshold * LEAD))
        return at, weights, lead, float(rest[lead]) if lead < len(rest) else 0.0

    def close(self) -> None:
        rows = [self.weighed(b) for b in self.blobs]
        self.rests = np.array([r[3] for r in rows])
        self.starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
        self.terms, self.weights = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        at = np.concatenate([r[0][: r[2]] for r in rows])
        order = np.argsort(at, kind="stable")
        self.targets = np.repeat(np.arange(len(rows), dtype=np.int32), [r[2] for r in rows])[order]
        self.products = np.concatenate([r[1][: r[2]] for r in rows])[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.idf)))])
        self.order, self.blobs, self.ready = np.array(self.ords, np.int64), [], True

    def near(self, blob: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the targets that reach the threshold, those that may be among the best `most`."""
        at, weights, lead, rest = self.weighed(blob)
        spans = [(a, b, w) for a, b, w in zip(self.ends[at[:lead]].tolist(), self.ends[at[:lead].astype(np.int64) + 1].tolist(), weights.tolist()) if b > a]
        if not spans:
            return np.empty(0, np.int64), np.empty(0)
        found = np.concatenate([self.targets[a:b] for a, b, _ in spans])
        sums = np.bincount(found, np.concatenate([self.products[a:b] * w for a, b, w in spans]), len(self.ids))
        # Terms that are not summed come after the leading terms of one of both, where that one has but its rest.
        some = np.flatnonzero(sums >= self.threshold * (1 - LEAD) - 1e-9)
        some = some[sums[some] + np.maximum(rest, self.rests[some]) >= self.threshold - 1e-9]
        if not len(some):
            return some, np.empty(0)
        self.dense[at] = weights
        sizes = self.starts[some + 1] - self.starts[some]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        cells = np.arange(sizes.sum()) + np.repeat(self.starts[some] - first, sizes)
        scores = np.add.reduceat(self.weights[cells] * self.dense[self.terms[cells]], first)
        self.dense[at] = 0.0
        good = scores >= self.threshold
        if np.count_nonzero(good) > most:
            good &= scores >= np.partition(scores, -most)[-most] - 1e-8
        return some[good], scores[good]


def nearest(s1: DataFrame, targets: DataFrame, top_k: int, threshold: float, max_features: int, ngram_range: tuple[int, int]) -> DataFrame:
    """s1_id, target_id, ord and score of pairs that reach the threshold, the best top_k of each S1 record among them."""
    sizes = range(ngram_range[0], ngram_range[1] + 1)
    known = texts(targets)
    n, words = targets.count(), vocabulary(known, sizes, max_features)
    numbers = {t: i for i, (t, _) in enumerate(words)}
    idf = s1.sparkSession.sparkContext.broadcast(np.log((n + 1) / (np.array([df for _, df in words], np.float64) + 1)) + 1)
    tasks = int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // BLOCK))
    shares = max(1, -(-min(tasks, CELLS) // blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for b in batches:
            out = []
            for key, share, kind, entity, order, vector in zip(*(b.column(c).to_pylist() for c in ("block", "share", "kind", "entity_id", "ord", "vector"))):
                if (key, share) != at:
                    at, block = (key, share), _Block(idf.value, threshold)
                if kind == 0:
                    block.ids.append(entity), block.ords.append(order), block.blobs.append(vector)
                    continue
                if not block.ids:
                    continue
                if not block.ready:
                    block.close()
                places, scores = block.near(vector, top_k)
                out.extend((entity, block.ids[j], o, s) for j, o, s in zip(places.tolist(), block.order[places].tolist(), scores.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.float64()))], ["s1_id", "target_id", "ord", "score"])

    of = lambda m: F.pmod(F.xxhash64("entity_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.array(*map(F.lit, range(m))))
    sides = [
        _vectors(known, numbers, sizes).select(of(blocks).alias("block"), every(shares).alias("share"), F.lit(0).alias("kind"), "entity_id", "ord", "vector"),
        _vectors(texts(s1), numbers, sizes).select(every(blocks).alias("block"), of(shares).alias("share"), F.lit(1).alias("kind"), "entity_id", "ord", "vector"),
    ]
    cells = sides[0].unionByName(sides[1]).repartitionById(blocks * shares, F.col("block") * shares + F.col("share")).sortWithinPartitions("block", "share", "kind")
    return cells.mapInArrow(run, "s1_id string, target_id string, ord long, score double")
