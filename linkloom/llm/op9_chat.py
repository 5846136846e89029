"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context and only its
reply is trained on.  A conversation that doesn't end with an assistant turn also gets one example
without a target, whose context is the whole conversation, so that no turn is lost.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a backslash is put after
the first character of each control string (of this template and of some public ones); a control string
that already holds backslashes gets one more, so taking one away gives the old text.

Defined results: turns are ordered by turn, then role, then text, nulls first; repeated rows stay; a
null role or text is empty; a null conversation id is a conversation.  An empty table gives no example.
A conversation is held by one task, for its digest must be; its examples are made one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tables import read

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string: of <|name|>, <s>, </s>, <SYS>, </SYS>, [INST], [/INST].
_TAIL = r"(\||/?s>|/?SYS>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*){_TAIL}", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*){_TAIL}", "$1$2$3")


def _written(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT), escape(turn["text"]), F.lit(END))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per example: conv, example (from 0), context, target (null if none; with its closing END), last."""
    rows = turns.select(F.col(conv).alias("__conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    held = rows.groupBy("__conv").agg(F.sort_array(F.collect_list("t")).alias("__turns"))
    held = held.select("__conv", F.transform("__turns", lambda t: F.struct(_written(t).alias("w"), (t["role"] == "assistant").alias("a"))).alias("__turns"))
    n = F.size("__turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("__turns", i)["a"] | (i == n))
    one = held.select("__conv", "__turns", n.alias("__n"), F.posexplode(ends).alias("example", "__end"))
    last = F.element_at("__turns", F.col("__end"))
    head = F.concat(F.lit(TURN + "assistant" + TEXT))
    before = F.array_join(F.transform(F.slice("__turns", F.lit(1), F.col("__end") - 1), lambda t: t["w"]), "")
    target = F.when(last["a"], F.substring(last["w"], F.length(head) + 1, F.length(last["w"])))
    context = F.concat(before, F.when(last["a"], head).otherwise(last["w"]))
    return one.select(F.col("__conv").alias(conv), F.col("example").cast("long").alias("example"), context.alias("context"), target.alias("target"), (F.col("__end") == F.col("__n")).alias("last"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) written in a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p: p != "")
    side = lambda p, k: unescape(F.get(F.split(F.substring(p, 1, F.length(p) - len(END)), r"<\|text\|>", -1), F.lit(k)))
    return F.transform(parts, lambda p: F.struct(side(p, 0).alias("role"), side(p, 1).alias("text")))


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, what its examples say when read again."""
    whole = F.concat("context", F.coalesce("target", F.lit("")))
    turns = F.when(F.col("last"), read_back(whole))
    trained = unescape(F.substring("target", 1, F.length("target") - len(END)))
    seen = formatted.select(conv, "example", F.length(whole).cast("long").alias("chars"), trained.alias("trained"), turns.alias("turns"))
    seen = seen.select(conv, "example", "chars", "trained", F.size("turns").alias("n"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"))
    out = seen.groupBy(conv).agg(
        F.max(F.when(F.col("n") >= 0, F.col("n"))).cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "trained"))), lambda x: F.coalesce(x["trained"], F.lit(""))), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return out.select(conv, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(examples(turns))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?SYS>|/?INST\])', '\1\\\2\3', 'g')"
SQL = rf"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
, b AS (SELECT *, row_number() OVER p AS rn, count(*) OVER (PARTITION BY conv_id) AS n
    , sum({len(TURN + TEXT + END)} + length({_ESC.format("role")}) + length({_ESC.format("text")})) OVER p AS chars
    FROM a WINDOW p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*)::BIGINT AS n_turns
    , sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256
    , coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars
    , sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256
    , coalesce(sum(chars) FILTER (role = 'assistant' OR rn = n), 0)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""
