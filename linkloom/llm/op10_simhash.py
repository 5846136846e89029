"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are made from hashed word shingles; equal ones are one node from there on.  The join
walks a binary trie of fingerprints against itself: a pair of trie nodes carries the number of
differing bits so far and is dropped when that exceeds the budget.  A pair whose remaining bits can't
exceed it any more is linked whole by a chain.  Links are united while the walk goes on, and a pair of
nodes whose fingerprints are all connected by then is dropped as well, so that a dense cluster costs
neither the time nor the memory of all its pairs.

To spread the join, bits are cut into blocks.  Two fingerprints within the budget of k bits agree in
at least m - k of m blocks, so they meet under some choice of m - k equal blocks; each choice deals the
fingerprints by these blocks' bits, and a trie is joined within each group.  m grows with the number of
fingerprints, which keeps groups small on average.  A group of more than GROUP_MOST is cut into pieces
by a hash, and each two pieces are joined by a task of their own.

A group gives links that join its connected members by a tree of bounded fan-out, never all pairs.

Defined results: a null text and one without words have fingerprint zero, linked like any other.
Repeated rows and exact copies share a fingerprint.  Texts of any length are hashed whole.  An empty
table gives an empty result.  Only the id and the text are read, so nulls in other columns and clashing
names don't matter; a null id is a component's smallest only where all its ids are null.  Of each
component keep_one() keeps one row whatever its ids are: that of the smallest id (null last), then of the
smallest hash of id and text; of rows equal in both, which are copies, any one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.components import components, tree, unite
from linkloom.llm.tables import lookup, named, read, small_batches, stage

WORDS, SEED, BUDGET = 4, 42, 4
#: Fingerprints that a group of the join should have at most on average, were bits independent.
GROUP_ROWS = 256
#: A group of more is joined in pieces of about half as many, two by two.
GROUP_MOST = 1 << 17
#: Hot groups up to so many (16 bytes each) are broadcast; beyond, their table is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Node pairs of the trie walk that are followed at once; more are walked in parts, and small groups together.
PAIRS, TOGETHER = 1 << 16, 1 << 15


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only 0x20 and 0x09 to 0x0D part words
    if not words:
        return 0
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = min(WORDS, len(words))
    starts = (ends - sizes)[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))


def blocks(m: int) -> list[tuple[int, int]]:
    """Cuts 64 bits into m blocks: (shift, width) from the lowest."""
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_count(rows: int, budget: int = BUDGET) -> int:
    """The fewest blocks for which groups stay small on average."""
    m = budget + 1
    while m < 10 and rows > GROUP_ROWS << (64 * (m - budget) // m):
        m += 1
    return m


def choices(m: int, budget: int = BUDGET) -> list[tuple[int, ...]]:
    return list(combinations(range(m), m - budget))


class _Walk:
    """The trie self-join of groups that lie one after the other in fps, each sorted and distinct."""

    def __init__(self, fps: np.ndarray, budget: int) -> None:
        self.fps, self.budget = fps, budget
        self.label = np.arange(len(fps))  # the smallest member so far connected with each
        self.ones: dict[int, np.ndarray] = {}
        self.turns: np.ndarray | None = None

    def middle(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the ones of a bit begin in each range; all earlier bits are equal in it."""
        if bit not in self.ones:
            self.ones[bit] = np.concatenate([[0], np.cumsum((self.fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)])
        c = self.ones[bit]
        return hi - (c[hi] - c[lo])

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        before, self.label = self.label, unite(self.label, i, j)
        if self.label is not before:
            self.turns = None

    def connected(self, node: np.ndarray) -> np.ndarray:
        """Which node pairs hold nothing but connected members."""
        if self.turns is None:  # how often the label has changed up to each place
            self.turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        a, b, c, e, _ = node.T
        return (self.turns[a] == self.turns[b - 1]) & (self.turns[c] == self.turns[e - 1]) & (self.label[a] == self.label[c])

    def link_whole(self, node: np.ndarray) -> None:
        """Chains through both ranges of each pair, and a link between them."""
        steps = np.zeros(len(self.fps) + 1, np.int64)
        for lo, hi in ((0, 1), (2, 3)):
            np.add.at(steps, node[:, lo], 1)
            np.add.at(steps, node[:, hi] - 1, -1)
        i = np.flatnonzero(np.cumsum(steps) > 0)
        self.unite(np.concatenate([i, node[:, 0]]), np.concatenate([i + 1, node[:, 2]]))

    def run(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The label of each fingerprint once all groups are joined."""
        zero = np.zeros(len(starts), np.int64)
        #: A stack of (bit, rows of: first range, second range, differing bits); a range with itself is one entry.
        stack = [(63, np.stack([starts, ends, starts, ends, zero], 1))]
        while stack:
            bit, node = stack.pop()
            if len(node) > PAIRS:  # those that differ least come first: they connect most
                node = node[np.argsort(-node[:, 4], kind="stable")]
                stack += [(bit, part) for part in np.array_split(node, 1 + len(node) // PAIRS)]
                continue
            node = node[~self.connected(node)]
            single = (node[:, 1] - node[:, 0] == 1) & (node[:, 3] - node[:, 2] == 1)
            if single.any():
                i, j, d = node[single, 0], node[single, 2], node[single, 4]
                rest = self.fps[i] ^ self.fps[j]
                if bit < 63:
                    rest = rest & np.uint64((1 << (bit + 1)) - 1)
                near = d + np.bitwise_count(rest).astype(np.int64) <= self.budget
                self.unite(i[near], j[near])
                node = node[~single]
            whole = node[:, 4] + bit + 1 <= self.budget
            if whole.any():
                self.link_whole(node[whole])
                node = node[~whole]
            if not len(node):
                continue
            a, b, c, e, d = node.T
            am, cm = self.middle(a, b, bit), self.middle(c, e, bit)
            own = a == c
            parts = [np.stack([a, am, cm, e, d + 1], 1), np.stack([am, b, c, cm, d + 1], 1)[~own], np.stack([a, am, c, cm, d], 1), np.stack([am, b, cm, e, d], 1)]
            nxt = np.concatenate(parts)
            nxt = nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= self.budget)]
            nxt = nxt[~((nxt[:, 0] == nxt[:, 2]) & (nxt[:, 1] - nxt[:, 0] == 1))]
            if len(nxt):
                stack.append((bit - 1, nxt))
        return self.label


def linked(fps: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each of fps (sorted, distinct uint64) the smallest index connected with it by links within the budget."""
    return _Walk(fps, budget).run(np.zeros(1, np.int64), np.full(1, len(fps))) if len(fps) else np.zeros(0, np.int64)


def _group_links(budget: int):
    """Links from rows (choice, bits, low, high, fp), sorted by the first four, which make a group."""

    def close(held: list[np.ndarray]) -> pa.RecordBatch:
        groups = [np.sort(g) for g in held]
        ends = np.cumsum([len(g) for g in groups])
        fps = np.concatenate(groups)
        label = _Walk(fps, budget).run(np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64))
        child, parent = tree(fps.view(np.int64), label)
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # whole groups
        now, parts, rows = None, [], 0

        def finish() -> None:
            nonlocal parts, rows
            if sum(map(len, parts)) > 1:
                held.append(np.concatenate(parts))
                rows += len(held[-1])
            parts = []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for lo, hi in zip(starts, [*starts[1:], len(fps)], strict=True):
                key = tuple(keys[lo].tolist())
                if key != now:
                    finish()
                    if rows > TOGETHER:
                        yield close(held)
                        held, rows = [], 0
                now = key
                parts.append(fps[lo:hi])
        finish()
        if held:
            yield close(held)

    return run


def fingerprint_links(fps: DataFrame, rows: int, budget: int = BUDGET, most: int = GROUP_MOST) -> DataFrame:
    """Links (a, b) that connect fingerprints within the budget; fps: a staged table of distinct longs `fp`."""
    m = block_count(rows, budget)
    cut = blocks(m)
    one = lambda i: F.shiftrightunsigned("fp", cut[i][0]).bitwiseAND(F.lit((1 << cut[i][1]) - 1))
    bits = [F.array(*(one(i) for i in c)) for c in choices(m, budget)]
    dealt = fps.select("fp", F.posexplode(F.array(*(F.xxhash64(b) for b in bits))).alias("choice", "bits"))
    hot = stage(dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "hot-groups")
    n_hot = hot.count()
    zero = F.lit(0).cast("long")
    if not n_hot:
        groups = dealt.select(F.col("choice").cast("long"), "bits", zero.alias("low"), zero.alias("high"), "fp")
    else:
        dealt = dealt.join(F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot, ["choice", "bits"], "left")
        pieces = F.ceil(F.col("n") * 2 / most).cast("long")  # three at least
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("pieces"))
        others = F.filter(F.sequence(zero, F.col("pieces") - 1), lambda q: q != F.col("piece"))
        spread = dealt.withColumn("pieces", pieces).withColumn("piece", own)
        spread = spread.withColumn("other", F.explode(F.when(F.col("n").isNull(), F.array(zero)).otherwise(others)))
        piece = F.coalesce("piece", zero)
        groups = spread.select(F.col("choice").cast("long"), "bits", F.least(piece, "other").alias("low"), F.greatest(piece, "other").alias("high"), "fp")
    key = ["choice", "bits", "low", "high"]
    return groups.repartition(*key).sortWithinPartitions(*key).mapInArrow(_group_links(budget), "a long, b long")


def _components(docs: DataFrame, *least: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with fp, classes): docs has text; classes has fp and the smallest struct of `least` in its component."""
    small_batches(docs.sparkSession)
    rows = stage(docs.withColumn("fp", F.arrow_udf(_fingerprints, "long").asNondeterministic()("text")).withColumn("mine", F.struct(*least)).drop("text"), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("mine").alias("least")), "nodes")
    links = stage(fingerprint_links(nodes.select("fp"), nodes.count()), "links")
    joined = components(links)
    of = stage(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "of")
    return rows, of


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (long), component_id (the smallest key reachable over links of fingerprints) of every row."""
    k = F.col("key")
    rows, of = _components(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), k.isNull().alias("none"), k.alias("key"))
    least = of.groupBy("c").agg(F.min("least")["key"].alias("component_id"))
    classes = stage(lookup(of, stage(least, "least"), "c").select("fp", "component_id"), "classes")
    return lookup(rows, classes, "fp").select(k.alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of docs."""
    own = named(docs, key, text)
    k = F.col("key")
    asked = own.select("h1", "h2", F.col("d")[key].alias("key"), F.col("d")[text].alias("text"))
    _, of = _components(asked, k.isNull().alias("none"), k.alias("key"), F.col("h1"), F.col("h2"))
    kept = stage(of.groupBy("c").agg(F.min("least").alias("x")).select("x.h1", "x.h2"), "kept")
    # Both steps use one shuffle; copies meet in it by id and text, so only rows that repeat an id in full share a key.
    return own.join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
