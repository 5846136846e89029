"""Candidates that score well, without a row per candidate pair: score is the mean of both word similarities.

Records meet at the keys of compact, targets first: a task holds the targets of one key (as many as its route takes)
and each S1 record of the key is scored against all of them at once, as sums of rows of a matrix of words and targets.
Only pairs that reach the least score leave the task, and only the best of a key where a cap on matches allows it.
Rare words bind records in too many small groups for their texts to travel: bounds from bit sets of words go first,
and texts meet for the pairs alone that may reach the least score, each at the first word by which it is found, so that
records with many words in common meet once.  Which words an S1 record takes is told for those that have such pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import text
from linkloom.operators import compact, routes
from linkloom.operators.routes import ROUTES
from linkloom.sources.stages import staged

#: S1 records of one key in a task; the targets of more frequent keys go to several tasks.
SHARE = 4096
#: Bits of a bit set of words, as two numbers.
BITS = 128
#: With fewer targets sets meet one by one.
FEW = 5
#: Cells of a matrix of words and targets; larger ones, of very long texts, are met set by set.
LARGEST = 1 << 25
_KEY = ["route", "h1", "h2"]
_OUT = "s1 long, target long, route int, score double, hit boolean"
_NAME, _ADDRESS, _JOINT, _RARE = (ROUTES.index(r) for r in ("exact_name", "exact_address", "exact_name_address", "rare_tokens"))


def words(normal: str) -> set[str]:
    """The words of a normal form."""
    return set(filter(None, normal.split(" ")))


def jaccard(a: set[str], b: set[str]) -> float:
    """1 if both are empty."""
    common = len(a & b)
    return common / every if (every := len(a) + len(b) - common) else 1.0


def signed(records: DataFrame) -> DataFrame:
    """records with their sound and the number of different words of name and address (n0, n1) and their bit sets (b00, b01, b10, b11)."""
    records = records.withColumn("sound", routes.phonetic_key(text.tokens(F.col("name_norm"))))
    fields = [("n0", "int"), ("b00", "long"), ("b01", "long"), ("n1", "int"), ("b10", "long"), ("b11", "long")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields), *(f"{n} {t}" for n, t in fields)])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[str, int] = {}

        def of(normal: str) -> tuple[int, int, int]:
            own, out = words(normal), 0
            for w in own:
                if (b := bits.get(w)) is None:
                    if len(bits) > 500_000:
                        bits.clear()
                    b = bits[w] = 1 << (zlib.crc32(w.encode()) % BITS)
                out |= b
            low, high = out & (1 << 64) - 1, out >> 64
            return len(own), low - (low >> 63 << 64), high - (high >> 63 << 64)

        for batch in batches:
            for first, column in ((0, "name_norm"), (3, "address_norm")):
                rows = [of(x) for x in batch.column(column).to_pylist()]
                for i, (name, kind) in enumerate(fields[first : first + 3]):
                    batch = batch.append_column(name, pa.array([r[i] for r in rows], pa.int32() if kind == "int" else pa.int64()))
            yield batch

    return records.mapInArrow(sets, schema)


def _most_shared(a: str, b: Column, i: int) -> Column:
    """At most so similar are the words of field i: each bit that only one record has is a word that the other lacks."""
    own = lambda c: F.col(f"{a}{c}")
    only = lambda x, y, j: F.bit_count(x(f"b{i}{j}").bitwiseAND(F.bitwise_not(y(f"b{i}{j}"))))
    lacks = lambda x, y: only(x, y, 0) + only(x, y, 1)
    of = lambda c: b[c]
    common = F.least(own(f"n{i}") - lacks(own, of), of(f"n{i}") - lacks(of, own))
    both = own(f"n{i}") + of(f"n{i}")
    return F.when(both == 0, 1.0 if i == 0 else 0.0).otherwise(common / F.greatest(both - common, F.lit(1)))


def _most_by_size(a: str, b: Column, i: int) -> Column:
    """At most so similar are sets of these sizes."""
    return F.coalesce(F.try_divide(F.least(F.col(f"{a}n{i}"), b[f"n{i}"]), F.greatest(F.col(f"{a}n{i}"), b[f"n{i}"])), F.lit(1.0 if i == 0 else 0.0))


def _filter_bits(keys: DataFrame, n: int) -> tuple[int, bytes]:
    """The h1 of keys as a bit set, of a size for n rows and 8 MB at most; two keys may share a bit."""
    size = min(1 << 26, max(1 << 16, 1 << (16 * n).bit_length()))
    at = F.col("h1").bitwiseAND(F.lit(size - 1))
    rows = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast((h1 & {size - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return size, out.tobytes()


def _maybe(df: DataFrame, bits: tuple[int, bytes], free: list[int]) -> DataFrame:
    """Rows of df whose h1 may be among the bits, and all of the routes `free`."""
    size, held = bits
    shared = df.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def there(h):
        at = h.to_numpy() & (size - 1)
        return pd.Series((np.frombuffer(shared.value, np.int64)[at >> 6] >> (at & 63)) & 1 == 1)

    return df.where(F.col("route").isin(free) | there("h1")) if free else df.where(there("h1"))


def _texts(df: DataFrame) -> DataFrame:
    """Only the texts that a route needs: equal names and addresses need none."""
    r = F.col("route")
    return df.withColumns({"name_norm": F.when(~r.isin(_NAME, _JOINT), F.col("name_norm")), "address_norm": F.when(~r.isin(_ADDRESS, _JOINT), F.col("address_norm"))})


def _plain(s1: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of S1 records and targets by key of the routes without rare words, of hot keys with a share."""
    phonetic = compact.nth("phonetic")
    asked, known = (compact._keyed(df, "name_norm", "address_norm", "g", once=once) for df, once in ((s1, True), (targets, False)))
    caps = F.element_at(F.create_map(*(F.lit(x) for r, n in compact.CAPS.items() for x in (compact.nth(r), n))), F.col("route"))
    place = F.row_number().over(W.partitionBy(*_KEY).orderBy("ord"))
    last = known.select(*_KEY, "ord").withColumn("_n", place).where((F.col("_n") <= max(compact.CAPS.values())) & (F.col("_n") == caps))
    cuts = staged(last.select(*_KEY, F.col("ord").alias("cut")), "cuts")
    hot = staged(asked.groupBy(*_KEY).count().where(F.col("count") > SHARE).select(*_KEY, F.ceil(F.col("count") / SHARE).cast("int").alias("shares")), "hot")
    plain = lambda df: df.where(F.col("route") != phonetic).select("h1")
    in_s1, in_targets = _filter_bits(plain(asked), 3 * s1.count()), _filter_bits(plain(known), 3 * targets.count())
    first = known.join(F.broadcast(cuts), _KEY, "left").where(F.col("cut").isNull() | (F.col("ord") <= F.col("cut"))).drop("cut")
    shares = lambda df: df.join(F.broadcast(hot), _KEY, "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    of_targets = shares(_maybe(first, in_s1, [phonetic])).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    of_s1 = shares(_maybe(asked, in_targets, [phonetic])).withColumn("share", F.pmod(F.xxhash64("ord"), F.col("shares")).cast("int")).drop("shares")
    return _texts(of_s1), _texts(of_targets)


def _among(df: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """df where the number of a column may be among the keys (h1), of which there are n; a few others stay."""
    return _maybe(df.withColumn("h1", F.col(column)), _filter_bits(keys, max(1, n)), []).drop("h1")


def of_targets(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """targets that staged pairs (ord) have, and a few others: a filter before a join, not instead of one."""
    found = pairs.select(F.col("ord").alias("h1")).distinct()
    return _among(targets, "ord", found, found.count())


def _rare(s1: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """s1, target and key (the first word by which s1 takes it) of the rare-token pairs that may reach the least score."""
    sets = ["n0", "b00", "b01", "n1", "b10", "b11"]
    own = [F.col(c).alias(f"own_{c}") for c in sets]
    df = staged(compact.word_counts(targets).where(F.col("df") >= compact.RARE["min_doc_freq"]), "words")
    asked_for = s1.select(F.explode(F.array_distinct(compact._words())).alias("key")).distinct()
    common = staged(df.where(compact.is_rare()).join(asked_for, "key").select(F.xxhash64("key").alias("h1")), "common")
    bits = _filter_bits(common, max(1, common.count()))
    some = lambda words: _maybe(words.withColumn("h1", F.xxhash64("key")), bits, []).drop("h1")
    rare, often = compact.rare_postings(targets, *sets, df=df, some=some)
    by_word = rare.groupBy("key").agg(F.collect_list(F.struct("ord", *sets)).alias("posting"))
    asked = some(compact.rare_asked(s1.select("*", *own), often, *(f"own_{c}" for c in sets))).join(by_word, "key")
    # From cheap to dear: most pairs end at the first or second.
    bounds = ((_most_by_size, _most_by_size), (_most_shared, _most_by_size), (_most_shared, _most_shared))
    may = lambda x: reduce(lambda p, q: p & q, (of_name("own_", x, 0) + of_address("own_", x, 1) >= 2 * least - 1e-9 for of_name, of_address in bounds))
    found = staged(asked.select("s1", "pos", "key", F.explode(F.transform(F.filter("posting", may), lambda x: x["ord"])).alias("target")), "may")
    # Words after the last one that matters need no look.
    last = staged(found.groupBy("s1").agg(F.max("pos").alias("most")), "last")
    who = _among(s1, "ord", last.select(F.col("s1").alias("h1")), last.count())
    again = some(compact.rare_asked(who, often)).join(last, "s1").where(F.col("pos") <= F.col("most")).select("s1", "pos", "key")
    postings = compact.rare_postings(targets, df=df, some=some)[0].groupBy("key").agg(F.collect_list("ord").alias("posting"))
    taken = found.join(compact.last_taken(again, postings), "s1").where(F.col("pos") <= F.col("last"))
    return taken.groupBy("s1", "target").agg(F.min(F.struct("pos", "key")).alias("first")).select("s1", "target", "first.key")


def _scorer(least: float, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    caps = {compact.nth(r): n for r, n in compact.CAPS.items()} | {_RARE: compact.RARE["max_candidates"]}

    def field(texts: list[str]):
        """Of the targets' texts a function that gives the similarity of another text to each of them."""
        sets = [words(t) for t in texts]
        if len(sets) < FEW:
            return sets
        sizes = np.array([len(s) for s in sets], np.float64)

        def of_common(own: set[str], common: np.ndarray) -> np.ndarray:
            every = sizes + len(own) - common
            return np.divide(common, every, out=np.ones(len(sizes)), where=every > 0)

        places: dict[str, int] = {}
        for s in sets:
            for w in s:
                places.setdefault(w, len(places))
        if len(places) * len(sets) > LARGEST:
            return sizes, lambda own: of_common(own, np.array([len(own & s) for s in sets], np.float64))
        table = np.zeros((len(places), len(sets)), np.float32)
        for j, s in enumerate(sets):
            table[[places[w] for w in s], j] = 1

        def similar(own: set[str]) -> np.ndarray:
            at = [p for w in own if (p := places.get(w)) is not None]
            return of_common(own, table[at].sum(0).astype(np.float64))

        return sizes, similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for batch in batches:
            out = [[], [], [], [], []]
            for *own, kind, order, name, address, g in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "share", "kind", "ord", "name_norm", "address_norm", "g"))):
                if own != key:
                    key, held, ready = own, [], None
                route = own[0]
                if kind == 0:
                    if len(held) < caps[route]:
                        held.append((order, name, address, g))
                    continue
                if not held:
                    continue
                if ready is None:
                    names = route not in (_NAME, _JOINT) and field([h[1] for h in held])
                    addresses = route not in (_ADDRESS, _JOINT) and field([h[2] for h in held])
                    ready = np.array([h[0] for h in held]), names, addresses
                ords, names, addresses = ready
                if len(held) < FEW:
                    some = []
                    mine = names and words(name), addresses and words(address)
                    for j, h in enumerate(held):
                        one = jaccard(mine[0], names[j]) if names else 1.0
                        if addresses:
                            n, m = len(mine[1]), len(addresses[j])
                            other = jaccard(mine[1], addresses[j]) if n and m and one + min(n, m) / max(n, m) >= 2 * least - 1e-9 else 0.0
                        else:
                            other = 1.0
                        if (one + other) / 2.0 >= least and (j == 0 or held[j - 1][0] != h[0]):
                            some.append(((one + other) / 2.0, j))
                    if most is not None and len(some) > most:
                        some = sorted(some, key=lambda x: (-x[0], x[1]))[:most]
                    for score, j in some:
                        for column, x in zip(out, (order, held[j][0], route, score, g is not None and g == held[j][3])):
                            column.append(x)
                    continue
                one = names[1](words(name)) if names else np.ones(len(held))
                if addresses:
                    mine = words(address)
                    n = len(mine)
                    # Not worth a look: even the most that sizes allow is too little.
                    room = one + np.minimum(addresses[0], n) / np.maximum(np.maximum(addresses[0], n), 1) >= 2 * least - 1e-9
                    if not room.any():
                        continue
                    score = (one + np.where((addresses[0] > 0) & (n > 0), addresses[1](mine), 0.0)) / 2.0
                else:
                    score = (one + 1.0) / 2.0
                good = np.flatnonzero(score >= least)
                if len(good) > 1:
                    # A number that a target repeats makes one pair.
                    good = good[np.sort(np.unique(ords[good], return_index=True)[1])]
                if most is not None and len(good) > most:
                    good = good[np.argsort(-score[good], kind="stable")[:most]]
                for j in good.tolist():
                    for column, x in zip(out, (order, held[j][0], route, float(score[j]), g is not None and g == held[j][3])):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()))], ["s1", "target", "route", "score", "hit"])

    return run


def matches(s1: DataFrame, targets: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """s1 and target (ords), route_rank, score, hit (a true pair) and rank of all candidates with a score of at least `least`, up to the first `most` of an S1 record.

    A pair that is not among the best of the route that ranks first for it has as many before it in all, so the best
    of each key are enough.  s1, targets: signed records with g.
    """
    cut = None if most is None else max(most, 2)
    asked, known = _plain(s1, targets)
    rare = staged(_rare(s1, targets, least), "rare")

    def at_word(records: DataFrame, side: str) -> DataFrame:
        """Rows of the records that rare pairs have, by the word at which a pair meets."""
        words = rare.select(F.col(side).alias("ord"), "key").distinct()
        texts = _among(records.select("ord", "name_norm", "address_norm", "g"), "ord", rare.select(F.col(side).alias("h1")).distinct(), n_rare)
        return words.join(texts, "ord").select(F.lit(_RARE).alias("route"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), F.lit(0).alias("share"), "ord", "name_norm", "address_norm", "g")

    n_rare = rare.count()
    offered, wanted = at_word(targets, "target"), at_word(s1, "s1")
    columns = [*_KEY, "share", "kind", "ord", "name_norm", "address_norm", "g"]
    tasks = int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scored(of_targets: DataFrame, of_s1: DataFrame, name: str) -> DataFrame:
        held, asking = (df.withColumn("kind", F.lit(k)).select(columns) for k, df in enumerate((of_targets, of_s1)))
        rows = held.unionByName(asking).repartition(tasks, *_KEY, "share").sortWithinPartitions(*_KEY, "share", "kind", "ord")
        return staged(rows.mapInArrow(_scorer(least, cut), _OUT), name)

    # One after the other, so that the texts of both are never on disk together.
    found = scored(known, asked, "plain").unionByName(scored(offered, wanted, "rare"))
    once = found.groupBy("s1", "target").agg((F.min("route") + 1).alias("route_rank"), F.max("score").alias("score"), F.max("hit").alias("hit"))
    rank = F.row_number().over(W.partitionBy("s1").orderBy(F.desc("score"), "route_rank", "target"))
    ranked = once.repartition("s1").withColumn("rank", rank)
    return ranked if cut is None else ranked.where(F.col("rank") <= cut)
