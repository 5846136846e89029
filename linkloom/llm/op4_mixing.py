"""Mixing sources to target weights by weighted fair queueing.

Every document stands in the queue of its source up to REPEATS times, each time in the same shuffled
order.  Its virtual finish time is the number of source tokens up to and with it, over the target of
the source.  All entries are sorted by that time and the queue is cut where their tokens reach the
total budget, so each source comes within a document of its target.

The sort is a range partitioning by time: the sums of whole ranges tell in which of them the budget
ends, running sums inside that one where, and the queue is truncated there.  Ranges follow from a
sample of the times, so none is large.  Running sums within a source use buckets of the shuffle key, so
that no task holds a source.

Defined results: a null text has size 0; the null source is a source, ordered last.  Documents of size
0 take nothing.  Ties go by source rank, shuffle key, id (null first), size and hash of the text;
repeated rows, and rows of one id or none, count each as a document, in mixed() too, where the copies of
rows equal in id, source and text are dealt evenly among them.  An empty table gives an empty result.  Texts of any length are counted whole.
Other input columns may have any name; mixed() keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.llm.tables import WORD, named, read, stage, summed

WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, 17
#: Buckets of a source's shuffle key: at 10^10 rows about 10^7 rows each.
BUCKETS = 1024
#: Up to so many sources their table (about 50 bytes each) is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST = 10_000


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """by_source (source, source_size; staged) with rank, target and budget.

    Targets share the whole size by weight; one that exceeds `repeats` times its source's size stops
    there and its excess is shared anew.  With sources ordered by cap over weight the ones that stop
    are a prefix: those whose cap over weight is at most the share left for a unit of weight.  Sources
    may be many: both orders are range sorts with running sums.
    """
    total = by_source.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("size")).first()
    n, size = total["n"], total["size"] or 0
    t = summed(by_source, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, "by-source", n)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = stage(summed(t, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "weights": F.col("weight")}, "by-ratio", n), "shares")
    all_weight = t.agg(F.sum("weight")).first()[0]
    t = t.withColumns({"left": F.lit(size) - F.col("caps") + F.col("cap"), "weight_left": F.lit(all_weight) - F.col("weights") + F.col("weight")})
    t = t.withColumn("full", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    rest = t.where(~F.col("full")).agg(F.max("left").alias("left"), F.max("weight_left").alias("weight")).first()
    share = F.lit(None).cast("double") if rest["left"] is None else F.lit(int(rest["left"])) * F.col("weight") / F.lit(int(rest["weight"]))
    return t.select("source", "source_size", "rank", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"), F.lit(size).cast("long").alias("budget"))


def _mix(rows: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """rows (h1, h2, k, source, text) as h1, h2, k, size, source_size, target and copies (how often the mix has the row)."""
    shuffled = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("k").cast("string"), F.lit(str(SEED)))), 1, 15), 16, 10).cast("long")
    base = stage(rows.select("h1", "h2", "k", "source", sizes(rows).alias("size"), shuffled.alias("h")), "sizes")
    bucket = F.shiftright("h", 60 - (BUCKETS.bit_length() - 1))
    sums = stage(base.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")), "buckets")
    plan = stage(targets(stage(sums.groupBy("source").agg(F.sum("n").alias("source_size")), "sources"), weights, repeats), "targets").withColumnRenamed("source", "s")
    whole = plan.agg(F.count(F.lit(1)).alias("n"), F.max("budget").alias("budget")).first()
    if whole["n"] <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    planned = lambda df: df.join(plan, F.col("source").eqNullSafe(F.col("s")), "inner").drop("s", "source", "budget")

    earlier = W.partitionBy("rank").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    firsts = planned(sums).select("rank", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    # A source's rows lie evenly in its BUCKETS, so neither this join nor the window has a hot key.
    inside = W.partitionBy("rank", "b").orderBy("h", "k", "size", "h1", "h2").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = planned(base).withColumn("b", bucket).join(firsts, ["rank", "b"], "inner")
    placed = stage(placed.withColumn("upto", F.col("first") + F.sum("size").over(inside)).drop("first", "b", "h"), "placed")

    # upto ascends within a source where documents have a size, so this order has no ties.
    order = ["time", "rank", "again", "upto"]
    time = lambda n: (F.col("upto") + F.col("source_size") * n) / F.when(F.col("target") > 0, F.col("target"))
    entries = placed.where("size > 0").withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select(time(F.col("again")).alias("time"), "rank", "again", "upto", "size")
    docs = sums.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    queue = summed(entries, [F.col(c) for c in order], {"run": F.col("size")}, "queue", repeats * docs)
    cut = queue.where(F.col("run") <= (whole["budget"] or 0)).agg(F.max(F.struct(*order)).alias("c")).first()["c"]

    def has(n: int) -> Column:
        if cut is None:
            return F.lit(0)
        last = F.struct(F.lit(cut["time"]).alias("time"), F.lit(cut["rank"]).cast("long").alias("rank"), F.lit(cut["again"]).alias("again"), F.lit(cut["upto"]).cast("long").alias("upto"))
        return (F.struct(time(n).alias("time"), F.col("rank").cast("long"), F.lit(n).alias("again"), F.col("upto").cast("long")) <= last).cast("int")

    copies = F.when(F.col("size") > 0, sum((has(n) for n in range(repeats)), F.lit(0))).otherwise(0)
    return placed.select("h1", "h2", "k", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """docs' rows as key, size, source_size, target, taken (words) and copies (how often the mix has the row)."""
    rows = named(docs, key, source, text).select("h1", "h2", F.col("d")[key].alias("k"), F.col("d")[source].alias("source"), F.col("d")[text].alias("text"))
    return _mix(rows, weights, repeats).select(F.col("k").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """docs with each row as often as the mix takes it.

    Equal rows share their copies: each has as many as all can have, and one of them the few that are left.
    """
    own = named(docs, key, source, text)
    rows = own.select("h1", "h2", F.col("d")[key].alias("k"), F.col("d")[source].alias("source"), F.col("d")[text].alias("text"))
    plan = _mix(rows, weights, repeats).groupBy("h1", "h2").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    plan = stage(plan.select("h1", "h2", F.floor(F.col("all") / F.col("rows")).cast("int").alias("each"), (F.col("all") % F.col("rows")).cast("int").alias("left")).where((F.col("each") > 0) | (F.col("left") > 0)), "copies")
    times = lambda df, n: df.select("d", F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy")).select("d.*")
    out = times(own.join(plan.where(F.col("each") > 0), ["h1", "h2"]), "each")
    left = plan.where(F.col("left") > 0).select("h1", "h2", "left")
    if not left.limit(1).count():
        return out
    return out.unionByName(times(own.join(left, ["h1", "h2"]).dropDuplicates(["h1", "h2"]), "left"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("copies")


SQL = rf"""
WITH d AS (SELECT doc_id AS k, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, ('0x' || substr(md5(doc_id || ':{SEED}'), 1, 15))::BIGINT AS h FROM documents)
, s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
, s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, {REPEATS} * source_size AS cap FROM s0)
, s2 AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM s1)
, s3 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS budget, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::BIGINT AS lft, (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::BIGINT AS wleft
    FROM s2 WINDOW p AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, s4 AS (SELECT *, cap * wleft <= lft * weight AS stops FROM s3)
, s5 AS (SELECT *, max(lft) FILTER (NOT stops) OVER () AS l, max(wleft) FILTER (NOT stops) OVER () AS w FROM s4)
, t AS (SELECT source, source_size, rank, budget, CASE WHEN stops THEN cap::DOUBLE ELSE l * weight / w END AS target FROM s5)
, p AS (SELECT k, size, source_size, rank, budget, target, sum(size) OVER (PARTITION BY rank ORDER BY h, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
, e AS (SELECT *, (upto + source_size * again) / target AS tm FROM p, (SELECT unnest(range({REPEATS})) AS again) WHERE size > 0)
, r AS (SELECT *, sum(size) OVER (ORDER BY tm, rank, again, upto ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e)
, c AS (SELECT rank, upto, sum(size)::BIGINT AS taken FROM r WHERE run <= budget GROUP BY rank, upto)
SELECT k AS doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken FROM p LEFT JOIN c USING (rank, upto)
"""
