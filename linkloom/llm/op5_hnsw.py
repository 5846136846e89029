"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors of a label (and dimension) are dealt over shards of about SHARD_ROWS vectors; equal vectors are
one node with a weight.  Each shard's graph is built once and written as a table.  Every vector of the
label then queries every shard: a graph meets BLOCK_ROWS queries in a task, which stream through it, so
that graphs weigh little beside the queries.

A search must pass two audits, and its beam doubles until it does.  Probes are nodes of the graph moved
to a cosine of just the threshold, where links are hardest to find: the search has to find WANTED of
them.  Then, of the queries that come together, some are compared with all nodes until AUDIT_LINKS true
links are seen (or an eighth of these queries is compared): the search has to find WANTED of those links
too.  Queries whose beam holds nothing but links are asked again with a wider one.  Queries whose beam
would pass MOST_BEAM are compared with all nodes instead, so no case is dropped; the result tells what
the audits have measured.

Candidates are verified by cosine in double precision.  Links are united as they come, never held as all
pairs; a task gives each query's number of links, and links that join its connected vectors by a tree.
Their union over tasks gives the components.

Defined results: vectors that are null, zero or hold a null or non-finite component, and vectors whose
label is null, have no links and are their own component.  Vectors of different dimension never link.
Equal vectors link with cosine 1.  vec_id names a vector: rows that repeat an id count as one node of
the graph and join what they link; a null id has no links.  Vectors may be as long as a task can hold a
shard of them.  An empty table gives an empty result.  Other input columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.components import components, tree, unite
from linkloom.llm.tables import lookup, read, small_batches, stage

THRESHOLD = 0.98
#: Vectors of a graph on average (at 1024 dimensions 64 MB), of a task's queries, and of those that come together.
SHARD_ROWS, BLOCK_ROWS, ASKED = 16_384, 262_144, 4_096
#: Neighbours of a node at the lowest level and above, beam while building and first beam of a query.
WIDE, NARROW, BUILD_BEAM, BEAM = 24, 12, 32, 16
MOST_BEAM, WANTED = 256, 0.99
#: Probes of a graph; queries compared at a time by the other audit, and links that end it.
PROBES, AUDITED, AUDIT_LINKS = 128, 48, 64
#: Least recall that the result promises.
LEAST_RECALL = 0.9
BATCH = 256
#: Float cosines this much under the threshold are verified.
SLACK = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) up to keep, each nearer to the row's node than to those kept before; then the best of the rest."""
    rows, n = ids.shape
    v = x[np.maximum(ids, 0)]
    among = v @ v.transpose(0, 2, 1)
    chosen, blocked, count = np.zeros((rows, n), bool), ids < 0, np.zeros(rows, np.int64)
    for j in range(n):
        take = ~blocked[:, j] & (count < keep)
        chosen[:, j] = take
        count += take
        blocked |= take[:, None] & (among[:, j] > sims) & ~chosen
    order = np.argsort(np.where(chosen, 0, np.where(ids < 0, 2, 1)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """x: unit vectors, ordered so that those of level l or more come first; near[l]: their neighbours, -1 for none."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray]) -> None:
        self.x, self.near = x, near

    @staticmethod
    def levels(n: int) -> list[int]:
        """How many of n nodes each level has."""
        out = [n]
        while out[-1] > 4 * NARROW:
            out.append(out[-1] // NARROW)
        return out

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        sizes = cls.levels(len(x))
        g = cls(x, [np.full((s, WIDE if level == 0 else NARROW), -1, np.int32) for level, s in enumerate(sizes)])
        done = 0
        while done < len(x):
            new = np.arange(done, min(len(x), done + min(BATCH, max(done, 32))))
            g._insert(new, done)
            done = int(new[-1]) + 1
        return g

    def _insert(self, new: np.ndarray, done: int) -> None:
        q = self.x[new]
        start = np.zeros((len(new), 1), np.int64)
        for level in range(len(self.near) - 1, -1, -1):
            size = len(self.near[level])
            here = new < size
            if done:
                found, sims = self.search(q, start, BUILD_BEAM if here.any() else 1, level)
                start = found[:, : 1 if not here.any() else 8]
                start = np.where(start < 0, start[:, :1], start)
            else:
                found, sims = np.full((len(new), 0), -1, np.int64), np.zeros((len(new), 0), np.float32)
            if not here.any():
                continue
            mates = new[here]
            own = self.x[mates] @ self.x[mates].T
            np.fill_diagonal(own, -2)
            ids = np.concatenate([found[here], np.broadcast_to(mates, (len(mates), len(mates)))], 1)
            s = np.concatenate([sims[here], own], 1)
            s[ids < 0] = -2
            top = np.argsort(-s, axis=1, kind="stable")[:, : BUILD_BEAM]
            ids, s = np.take_along_axis(ids, top, 1), np.take_along_axis(s, top, 1)
            ids = np.where(s <= -2, -1, ids)
            keep = self.near[level].shape[1]
            forward = 2 * keep // 3  # the rest is room for links back
            self.near[level][mates, :forward] = _diverse(s, ids, self.x, forward)
            self._back(level, mates)

    def _back(self, level: int, mates: np.ndarray) -> None:
        """Links from the neighbours of new nodes back to them."""
        near = self.near[level]
        to = near[mates].ravel()
        of = np.repeat(mates, near.shape[1])
        to, of = to[to >= 0], of[to >= 0]
        if not len(to):
            return
        known = (near[to] == of[:, None]).any(1)
        to, of = to[~known], of[~known]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[to], self.x[of]), to))
        to, of = to[order], of[order]
        nodes, first = np.unique(to, return_index=True)
        nth = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        most = 12
        to, of, nth = to[nth < most], of[nth < most], nth[nth < most]
        more = np.full((len(nodes), most), -1, np.int64)
        more[np.searchsorted(nodes, to), nth] = of
        ids = np.concatenate([near[nodes], more], 1)
        s = np.einsum("ijk,ik->ij", self.x[np.maximum(ids, 0)], self.x[nodes])
        s[ids < 0] = -2
        order = np.argsort(-s, axis=1, kind="stable")
        ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
        near[nodes] = _diverse(s, ids, self.x, near.shape[1])

    def search(self, q: np.ndarray, start: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of a beam of nodes near each query, best first, -1 for none."""
        near, rows = self.near[level], np.arange(len(q))
        width = max(beam, start.shape[1])
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -2, np.float32)
        again = np.zeros(start.shape, bool)
        for j in range(1, start.shape[1]):
            again[:, j] = (start[:, :j] == start[:, j : j + 1]).any(1)
        ids[:, : start.shape[1]] = np.where(again, -1, start)
        sims[:, : start.shape[1]] = np.where(again, -2, np.einsum("ijk,ik->ij", self.x[start], q))
        seen = np.zeros((len(q), len(near)), bool)
        seen[rows[:, None], start] = True
        open_ = ids >= 0
        live = rows
        while len(live):
            best = np.where(open_[live], sims[live], -3).argmax(1)
            on = open_[live, best]
            live, best = live[on], best[on]
            if not len(live):
                break
            open_[live, best] = False
            nxt = near[ids[live, best]].astype(np.int64)
            fresh = (nxt >= 0) & ~seen[live[:, None], np.maximum(nxt, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], nxt[r, c]] = True
            s = np.full(nxt.shape, -2, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.x[nxt[r, c]], q[live[r]])
            all_ids = np.concatenate([ids[live], np.where(fresh, nxt, -1)], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1)[:, :beam], np.take_along_axis(sims, order, 1)[:, :beam]

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.near) - 1, 0, -1):
            start = self.search(q, start, 4, level)[0]
            start = np.where(start < 0, start[:, :1], start)
        return self.search(q, start, beam, 0)

    def dump(self) -> bytes:
        """Levels are given by the number of nodes, so only neighbours are kept."""
        return b"".join(a.astype("<i4").tobytes() for a in self.near)

    @classmethod
    def load(cls, x: np.ndarray, data: bytes) -> Graph:
        near, at = [], 0
        for level, s in enumerate(cls.levels(len(x))):
            width = WIDE if level == 0 else NARROW
            near.append(np.frombuffer(data, "<i4", s * width, at).reshape(s, width))
            at += 4 * s * width
        return cls(x, near)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


class Searcher:
    """Finds links of queries in a graph; counts what the audits saw (`true`, `found`) and how many queries were compared with all (`compared`)."""

    def __init__(self, graph: Graph, threshold: float) -> None:
        self.graph, self.threshold = graph, threshold
        self.true = self.found = self.compared = self.asked = 0
        self.beam = self._probed()

    def _probed(self) -> int:
        """The least beam that finds WANTED of the probes; over MOST_BEAM if none does."""
        x, rng = self.graph.x, np.random.default_rng(len(self.graph.x))
        nodes = rng.permutation(len(x))[:PROBES]
        own = x[nodes].astype(np.float64)
        aside = rng.normal(size=own.shape)
        aside -= np.einsum("ij,ij->i", aside, own)[:, None] * own
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.divide(aside, size, out=np.zeros_like(aside), where=size > 1e-9)
        probes = unit(self.threshold * own + np.sqrt(max(0.0, 1 - self.threshold**2)) * aside)
        beam = BEAM
        while beam <= MOST_BEAM:
            ids, sims = self.graph.nearest(probes, beam)
            # A beam full of nodes that are as near has done its work: such a query is asked again anyway.
            hit = (ids == nodes[:, None]).any(1) | (sims[:, -1] >= self.threshold - SLACK)
            if hit.sum() >= WANTED * len(nodes):
                self.true, self.found = self.true + len(nodes), self.found + int(hit.sum())
                break
            beam *= 2
        return beam

    def _audit(self, q: np.ndarray, itself: np.ndarray) -> np.ndarray:
        """True links (query, node) of queries drawn until enough links are seen; itself: each query's own node, -1 if none."""
        order = np.random.default_rng(len(q)).permutation(len(q))
        most, out, links = max(AUDITED, len(q) // 8), [np.zeros((0, 2), np.int64)], 0
        for i in range(0, min(most, len(q)), AUDITED):
            drawn = order[i : i + AUDITED]
            r, c = np.nonzero(q[drawn] @ self.graph.x.T >= self.threshold - SLACK)
            other = c != itself[drawn[r]]
            out.append(np.stack([drawn[r[other]], c[other]], 1))
            if (links := links + int(other.sum())) >= AUDIT_LINKS:
                break
        return np.concatenate(out)

    def _by_graph(self, q: np.ndarray, todo: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs about or over the threshold, and the queries whose beam holds nothing else."""
        part, full = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(todo), BATCH):
            own = todo[i : i + BATCH]
            ids, sims = self.graph.nearest(q[own], beam)
            hit = sims >= self.threshold - SLACK
            r, c = np.nonzero(hit)
            part.append(np.stack([own[r], ids[r, c]], 1))
            full.append(own[hit[:, -1]])
        return np.concatenate(part), np.concatenate(full)

    def find(self, q: np.ndarray, itself: np.ndarray) -> Iterator[np.ndarray]:
        """(query, node) pairs that may be links, in parts of at most BATCH queries' worth where these are compared with all."""
        n = len(self.graph.x)
        truth = self._audit(q, itself)
        todo, beam = np.arange(len(q)), self.beam
        self.asked += len(q)
        while len(todo) and beam <= MOST_BEAM:
            pairs, full = self._by_graph(q, todo, beam)
            want = truth[np.isin(truth[:, 0], todo) & ~np.isin(truth[:, 0], full)]
            got = int(np.isin(want @ [n, 1], pairs @ [n, 1]).sum())
            if got >= WANTED * len(want):
                self.true, self.found = self.true + len(want), self.found + got
                yield pairs[~np.isin(pairs[:, 0], full)]
                todo = full
            beam *= 2
        self.compared += len(todo)
        for i in range(0, len(todo), BATCH):
            own = todo[i : i + BATCH]
            r, c = np.nonzero(q[own] @ self.graph.x.T >= self.threshold - SLACK)
            yield np.stack([own[r], c], 1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal values in names; a run may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(keys[lo].tolist()), batch.slice(lo, hi - lo)


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def close() -> pa.RecordBatch:
        ids = np.concatenate([b.column("rep").to_numpy() for b in held])
        weights = np.concatenate([b.column("weight").to_numpy() for b in held])
        x = np.concatenate([_vectors(b.column("embedding")) for b in held]).astype(np.float64)
        graph = Graph.build(unit(x))
        row = [now[0], now[1], ids.astype("<i8").tobytes(), weights.astype("<i8").tobytes(), x.astype("<f8").tobytes(), graph.dump()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["lab", "shard", "ids", "weights", "vectors", "near"])

    for key, part in _groups(batches, ["lab", "shard"]):
        if now is not None and key != now:
            yield close()
            held = []
        now = key
        held.append(part)
    if held:
        yield close()


#: What a row of the search tells: a link of the tree (a, b); the links (n) of a query a; of a label a, the true links of audits (n) and those found (b); the queries (n) and those compared with all nodes (b).
LINK, COUNT, AUDIT, ASKS = 0, 1, 2, 3


def _searched(threshold: float):
    """Rows of (label, shard, block), the graph first and then queries, as (kind, a, b, n)."""

    def answers(index: tuple, searcher: Searcher, held: list) -> pa.RecordBatch:
        nodes, weights, x = index
        own = np.concatenate([b.column("rep").to_numpy() for b in held])
        q = np.concatenate([_vectors(b.column("embedding")) for b in held]).astype(np.float64)
        order = np.argsort(nodes)
        at = order[np.minimum(np.searchsorted(nodes, own, sorter=order), len(nodes) - 1)]
        itself = np.where(nodes[at] == own, at, -1)
        everyone, place = np.unique(np.concatenate([own, nodes]), return_inverse=True)
        links, label = np.zeros(len(own), np.int64), np.arange(len(everyone))
        for found in searcher.find(unit(q), itself):
            for pairs in np.array_split(found, 1 + len(found) // 65_536):
                pairs = pairs[pairs[:, 1] != itself[pairs[:, 0]]]
                pairs = pairs[_cosine(q[pairs[:, 0]], x[pairs[:, 1]]) >= threshold]
                np.add.at(links, pairs[:, 0], weights[pairs[:, 1]])
                label = unite(label, place[: len(own)][pairs[:, 0]], place[len(own) :][pairs[:, 1]])
        child, parent = tree(everyone, label)
        some = own[links > 0]
        return _told(np.repeat([LINK, COUNT], [len(child), len(some)]), np.concatenate([child, some]), np.concatenate([parent, some]), np.concatenate([np.zeros(len(child), np.int64), links[links > 0]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = index = searcher = None
        held, rows = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if held and searcher is not None:
                yield answers(index, searcher, held)
            held, rows = [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            yield from close()
            if searcher is not None:
                yield _told(np.array([AUDIT, ASKS]), np.full(2, now[0]), np.array([searcher.found, searcher.compared]), np.array([searcher.true, searcher.asked]))

        for key, part in _groups(batches, ["lab", "shard", "block"]):
            if key != now:
                yield from finish()
                now, index, searcher = key, None, None
            rest = part
            if index is None:  # the graph comes first
                row = part.slice(0, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], "<i8")
                x = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
                index = ids, np.frombuffer(row["weights"], "<i8"), x
                searcher = Searcher(Graph.load(unit(x), row["near"]), threshold)
                rest = part.slice(1)
            if rest.num_rows:
                held.append(rest.select(["rep", "embedding"]))
                rows += rest.num_rows
                if rows >= ASKED:
                    yield from close()
        yield from finish()

    return run


def _told(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "a", "b", "n"])


def searched(vectors: DataFrame, key: str, vector: str, label: str, threshold: float, shard_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged tables: rows (id, g), distinct vectors (g, rep, weight, lab), and what the searches tell (kind, a, b, n)."""
    small_batches(vectors.sparkSession)
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.xxhash64(F.col(label).cast("string"), F.size(vector)).alias("lab"), F.when(F.coalesce(good, F.lit(False)), v).alias("embedding"))
    rows = rows.withColumn("g", F.unhex(F.sha2(F.concat_ws(",", F.col("lab").cast("string"), F.col("embedding").cast("array<string>")), 256))).withColumn("g", F.when(F.col("embedding").isNotNull(), F.col("g")))
    reps = stage(rows.where(F.col("g").isNotNull() & F.col("id").isNotNull()).groupBy("g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("lab").alias("lab"), F.first("embedding").alias("embedding")), "reps")
    counts = stage(reps.groupBy("lab").agg(F.count(F.lit(1)).alias("n")), "label-counts")
    parts = lambda size: F.ceil(F.col("n") / F.lit(size)).cast("int")
    nodes = stage(lookup(reps.drop("g"), counts, "lab").select("lab", "rep", "weight", "embedding", parts(shard_rows).alias("shards"), parts(BLOCK_ROWS).alias("blocks")), "vectors")
    shard = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shards")).cast("int")
    index = nodes.select("lab", shard.alias("shard"), "rep", "weight", "embedding").repartition("lab", "shard").sortWithinPartitions("lab", "shard", F.xxhash64("rep", F.lit(2)))
    index = stage(index.mapInArrow(_builder, "lab long, shard int, ids binary, weights binary, vectors binary, near binary"), "graphs")

    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    graphs = index.join(counts, "lab").select("lab", "shard", every(parts(BLOCK_ROWS)).alias("block"), "ids", "weights", "vectors", "near")
    block = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    asks = nodes.select("lab", every(F.col("shards")).alias("shard"), block.alias("block"), "rep", "embedding")
    both = graphs.unionByName(asks, allowMissingColumns=True).repartition("lab", "shard", "block").sortWithinPartitions("lab", "shard", "block", F.col("near").isNull())
    told = stage(both.mapInArrow(_searched(threshold), "kind long, a long, b long, n long"), "found")
    return stage(rows.select("id", "g"), "vector-groups"), reps.select("g", "rep", "weight", "lab"), told


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, n_links, component_id and recall (what the audits of the label measured; null without a search) of every row of vectors."""
    held, reps, told = searched(vectors, key, vector, label, threshold, shard_rows)
    joined = components(told.where(F.col("kind") == LINK).select("a", "b"), "vector-links")
    links = told.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    audits = stage(told.where(F.col("kind") == AUDIT).groupBy(F.col("a").alias("lab")).agg((F.sum("b") / F.sum("n")).alias("recall")), "audits")
    each = reps.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    each = stage(each.select("g", "lab", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "each")
    each = stage(lookup(each, audits, "lab").drop("lab"), "measured")
    return lookup(held, each, "g").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), "recall")


def search_report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row: searches (graph and task), queries, those compared with all nodes, true links and probes of audits, those found."""
    told = searched(vectors, key, vector, label, threshold, shard_rows)[2]
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    return told.agg(F.count_if(F.col("kind") == ASKS).alias("searches"), of(ASKS, "n").alias("queries"), of(ASKS, "b").alias("compared"), of(AUDIT, "n").alias("true"), of(AUDIT, "b").alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(read(spark, sf_dir, "embeddings"))
    met = F.coalesce(F.col("recall") >= LEAST_RECALL, F.lit(True))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), met.alias("recall_met"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD})
, r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
, c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
, n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept, TRUE AS recall_met FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
