"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers; their spans always
stay.  Further high-recall patterns propose spans, which may overlap each other and the base ones:
numbers in groups, identity numbers, assignments of secrets, and addresses written in words.  Each
candidate gets features of its format and of the text before it; boosted trees give it a score, and it
becomes a span if the score reaches the calibrated threshold of its kind.

The trees are fitted on examples that SQL expressions generate (EXAMPLES of them, a fixed number): real
forms in and out of context, and look-alikes such as dates, prices, versions, part numbers and words
after "key".  Every other example is held out, and the threshold of a kind is the lowest at which
PRECISION of its held-out candidates over it are real.  The fitted trees are a constant array that a
plain column expression walks, so the plan doesn't grow with them, and the search runs over each row's
candidates without a join, a shuffle or an exploded row.

Defined results: a null or empty text has no span.  Positions are code points, ends exclusive; spans go
by start, then kind.  Texts of any length are searched whole; patterns are linear in the text, and what
is done with n matches takes about n to the power 1.5 small steps.  Rows are independent, so ties,
repeated rows and empty tables need no rule.  spans() replaces input columns named like its two results;
redact() keeps all columns whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tables import read, stage

#: Base patterns.  They match what the plain forms match, but possessively and never from within a run,
#: so that long runs of letters or digits cost a single pass.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns that propose candidates, and what a text must hold for a pattern to be tried.
CANDIDATES = {
    "phone_like": (r"(?<!\+[0-9]{1,3}[ ]?)(?<![0-9A-Za-z+@.-])\(?[0-9]{2,5}\)?(?:[ .-]{1,2}[0-9]{2,5}){1,5}+(?![0-9A-Za-z])", "[0-9][) .-]{1,2}[0-9]"),
    "id_number": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-[0-9]{2}-"),
    "secret": (r"(?i)(?<![a-z0-9])(?:[a-z]{1,20}[_-]){0,3}(?:key|secret|token|passw(?:or)?d|pwd)[\"']?[ ]?[=:][ ]?[\"']?[a-z0-9+/_.=-]{6,}+[\"']?", "(?i)(?:key|secret|token|passw(?:or)?d|pwd)[\"']?[ ]?[=:]"),
    "email_like": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+[ ]?(?:\[at\]|\(at\)|(?<=[ ])at(?=[ ]))[ ]?[a-z0-9-]{1,63}+[ ]?(?:\[dot\]|\(dot\)|(?<=[ ])dot(?=[ ]))[ ]?[a-z]{2,10}(?![a-z])", r"(?i)(?:\[dot\]|\(dot\)|[ ]dot[ ])"),
}
KINDS = [*BASE, *CANDIDATES]
_CONTEXT = {"says_phone": r"(?i)(?:phone|tel|call|mobile|fax|whatsapp)\W{0,4}$", "says_id": r"(?i)(?:ssn|social security|identity|passport|tax id)\D{0,8}$", "says_mail": r"(?i)(?:mail|contact|write|reach)\W{0,3}(?:me |us |to ){0,2}$", "says_code": r"(?i)(?:part|sku|order|item|ref|serial|model|code)(?: no)?\W{0,3}$"}
FEATURES = ["kind", "length", "digits", "letters", "upper", "groups", "first", "last", "dots", "dashes", "parens", "quotes", "brackets", "switches", "leading_zero", "signs", *_CONTEXT]

EXAMPLES, PRECISION, TREES, DEPTH, SEED = 4096, 0.99, 12, 4, 11
#: Characters before a candidate that its features see, and of a chunk of text.
_BEFORE, _CHUNK = 24, 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, largest: bool = False) -> Column:
    """Running sums (or maxima from 0) of an array of integers.

    Blocks of about sqrt(n) values are summed first, then what lies before each block is added: appending
    to an array copies it, so appending n values to one array would take the square of n.
    """
    join = F.greatest if largest else lambda a, b: a + b
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    none = F.array().cast("array<int>")

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda b: F.slice(v, b * w + 1, w)))
        inside = F.transform(blocks, lambda x: F.aggregate(x, none, lambda acc, y: F.concat(acc, F.array(join(last(acc), y)))))

        def joined(i: Column) -> Column:
            before = F.aggregate(i, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(join(last(acc), last(x)))))
            return F.flatten(F.transform(F.arrays_zip(i.alias("i"), before.alias("b")), lambda z: F.transform(F.coalesce(z["i"], none), lambda x: join(z["b"], x))))

        return F.when(F.size(v) > 0, let(inside, joined)).otherwise(none)

    return let(values, of)


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, m): the matches of a pattern with their positions in code points."""

    def placed(x: Column) -> Column:
        ends = running(F.transform(F.arrays_zip(x["gaps"], x["ms"]), lambda z: F.length(z["gaps"]) + F.coalesce(F.length(z["ms"]), F.lit(0))))
        each = F.transform(F.arrays_zip(x["ms"], ends.alias("end")), lambda z: F.struct((z["end"] - F.length(z["ms"])).alias("start"), z["end"].alias("end"), z["ms"].alias("m")))
        return F.slice(each, F.lit(1), F.size(x["ms"]))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms")), placed)


def chunks(text: Column) -> Column:
    """The text in parts of _CHUNK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The text from start to end, found from its chunks: its beginning isn't read through."""
    first = F.floor(start / _CHUNK).cast("int")
    few = F.slice(parts, first + 1, F.greatest(F.ceil(end / _CHUNK).cast("int") - first, F.lit(0)))
    return F.substring(F.array_join(few, ""), start - first * _CHUNK + 1, F.greatest(end - start, F.lit(0)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a non-empty string of digits passes the check of card numbers."""
    n = F.length(digits)

    def worth(i: Column) -> Column:  # i from 1 at the right end
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str):
    if kind == "ip":
        return lambda x: F.forall(F.split(x["m"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 2) | (F.ltrim(p, F.lit("0")).between("100", "255") & (F.length(F.ltrim(p, F.lit("0"))) == 3)))
    if kind == "card":
        return lambda x: F.when(F.length(_digits(x["m"])).between(14, 19), luhn(_digits(x["m"]))).otherwise(F.lit(False))
    if kind == "phone":
        return lambda x: F.length(_digits(x["m"])).between(10, 15)
    return lambda x: F.lit(True)


def features(m: Column, before: Column, kind: Column) -> Column:
    """An array of doubles for a candidate, by FEATURES."""
    kept = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    values = {
        "kind": kind,
        "length": F.length(m),
        "digits": kept("0-9"),
        "letters": kept("A-Za-z"),
        "upper": kept("A-Z"),
        "groups": F.size(groups),
        "first": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        "last": F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        "dots": kept("."),
        "dashes": kept("-"),
        "parens": kept("()"),
        "quotes": kept("\"'"),
        "brackets": kept(r"\[\](){}"),
        "switches": F.size(F.regexp_extract_all(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))),
        "leading_zero": m.rlike("^[(]?0").cast("int"),
        "signs": kept("/_"),
        **{k: before.rlike(p).cast("int") for k, p in _CONTEXT.items()},
    }
    return F.array(*(values[f].cast("double") for f in FEATURES))


def examples(spark: SparkSession) -> DataFrame:
    """Generated candidates: kind (number), before, m, whether it is personal (label) and whether it is held out."""
    draw = lambda salt, below: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below))
    digits = lambda salt, n: F.lpad(draw(salt, 10**n).cast("string"), n, "0")
    pick = lambda salt, *options: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (draw(salt, len(options)) + 1).cast("int"))
    hexes = lambda salt, n: F.substring(F.concat(*(F.sha1(F.concat_ws("/", "id", F.lit(f"{salt}{i}"))) for i in range(2))), 1, n)
    word = lambda salt: F.translate(F.substring(F.md5(F.concat_ws("/", "id", F.lit(salt))), 1, 9), "0123456789", "ghijklmnop")
    plain = pick("w", "", "with the ", "and of ", "see ", "was ")
    cased = lambda c: pick("case", c, F.upper(c))
    phone, number, secret, mail = (KINDS.index(k) for k in CANDIDATES)
    name = pick("name", "token", "api_key", "password", "secret", "access-key", "PASSWORD", "Token")
    at, dot = pick("at", " [at] ", " (at) ", "[at]", " at "), pick("dot", " [dot] ", " (dot) ", "[dot]", " dot ")
    forms = [
        (phone, 1, pick("c", "phone: ", "call ", "tel ", "mobile: ", plain), F.concat(F.lit("("), digits("a", 3), F.lit(") "), digits("b", 3), F.lit("-"), digits("d", 4))),
        (phone, 1, pick("c", "phone: ", "call ", "tel. ", "fax "), F.concat(digits("a", 3), pick("s", "-", " ", "."), digits("b", 3), pick("s", "-", " ", "."), digits("d", 4))),
        (number, 1, pick("c", "ssn ", "social security ", "ssn: ", plain), F.concat(digits("a", 3), F.lit("-"), digits("b", 2), F.lit("-"), digits("d", 4))),
        (secret, 1, plain, F.concat(name, F.lit(' = "'), cased(hexes("h", 40)), F.lit('"'))),
        (secret, 1, plain, F.concat(name, pick("s", "=", ": ", " = "), pick("v", hexes("h", 12), hexes("h", 16), hexes("h", 32), F.repeat(hexes("h", 80), 6), F.concat(word("w"), digits("a", 3))))),
        (mail, 1, pick("c", "mail ", "contact ", "write to ", plain), F.concat(word("u"), F.lit("."), digits("a", 2), at, word("h"), dot, pick("tld", "com", "org", "net"))),
        (mail, 1, plain, F.concat(word("u"), pick("at2", " [at] ", "(at)"), word("h"), pick("dot2", " [dot] ", "(dot)"), pick("tld", "com", "org", "net"))),
        (phone, 0, plain, F.concat(pick("y", "19", "20"), digits("a", 2), pick("s", "-", ".", " "), digits("b", 2), pick("s", "-", ".", " "), digits("d", 2))),
        (phone, 0, plain, F.concat(digits("b", 2), pick("s", "-", ".", " "), digits("d", 2), pick("s", "-", ".", " "), pick("y", "19", "20"), digits("a", 2))),
        (phone, 0, plain, F.concat_ws(" ", digits("a", 2), digits("b", 3), digits("d", 3))),
        (phone, 0, plain, F.concat(digits("a", 4), pick("s", " ", "-"), digits("b", 4), pick("s", " ", "-"), digits("d", 4), pick("s", " ", "-"), digits("e", 4))),
        (phone, 0, plain, F.concat_ws(".", digits("a", 3), digits("b", 2), digits("d", 3), digits("e", 2))),
        (phone, 0, plain, F.concat(digits("a", 4), pick("s", " ", "-", "."), digits("b", 4))),
        (phone, 0, plain, F.concat(F.lit("978-"), digits("a", 2), F.lit("-"), digits("b", 5), F.lit("-"), digits("d", 2))),
        (secret, 0, plain, F.concat(pick("n", "key", "token", "secret", "the-key"), pick("s", ": ", " = ", "="), word("w"))),
        (mail, 0, plain, F.concat(word("u"), F.lit(" at "), word("h"), F.lit(" dot "), word("z"))),
        (phone, 0, pick("c", "part no. ", "order ", "item ", "serial: "), F.concat(digits("a", 3), pick("s", "-", " ", "."), digits("b", 3), pick("s", "-", " ", "."), digits("d", 4))),
        (number, 0, pick("c", "part ", "sku ", "order no. ", "ref: "), F.concat(digits("a", 3), F.lit("-"), digits("b", 2), F.lit("-"), digits("d", 4))),
        (secret, 0, plain, F.concat(pick("n", "key", "token", "secret"), pick("s", ": ", " = ", "="), pick("v", F.concat_ws("-", F.lit("2024"), digits("a", 2), digits("b", 2)), F.concat(F.lit("/"), word("x"), F.lit("/"), word("y")), F.concat(word("x"), F.lit("_"), word("y"))))),
    ]
    which = F.pmod(F.col("id"), F.lit(len(forms)))
    rows = spark.range(0, EXAMPLES, 1, 2).withColumn("held", F.floor(F.col("id") / len(forms)) % 2 == 1)  # forms alternate by id, so halves have all forms
    each = [F.struct(F.lit(k).alias("kind"), F.lit(float(y)).alias("label"), b.alias("before"), m.alias("m")) for k, y, b, m in forms]
    return rows.select("id", "held", reduce(lambda acc, ie: acc.when(which == ie[0], ie[1]), list(enumerate(each))[1:], F.when(which == 0, each[0])).alias("x")).select("id", "held", "x.*")


def _tree(text: str) -> list:
    """A fitted tree as nested lists [feature, limit, at most, above] with numbers as leaves."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if "If (" in x or "Else (" in x or "Predict:" in x]
    at = 0

    def node():
        nonlocal at
        line = lines[at][1]
        at += 1
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, limit = re.search(r"feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # its Else
        return [int(feature), float(limit), low, node()]

    return node()


#: (trees, threshold by kind) of each application.
_FITTED: dict[str, tuple[list[tuple[float, list]], dict[int, float]]] = {}


def fit(spark: SparkSession) -> tuple[list[tuple[float, list]], dict[int, float]]:
    """(weight, tree) of all trees and the threshold of their sum for each kind; once an application."""
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        rows = examples(spark).select("held", "kind", "label", features(F.col("m"), F.col("before"), F.col("kind")).alias("f"))
        # Staged, for the fit reads it many times, and each plan over the generated texts is large.
        rows = stage(rows.coalesce(1), "pii-examples")
        train = rows.where("not held").select("label", array_to_vector("f").alias("features"))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=64).fit(train)
        trees = [(w, _tree(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        scores = rows.where("held").select("kind", "label", margin(F.col("f"), trees).alias("s")).groupBy("kind", "s").agg(F.sum("label").alias("real"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect()  # at most EXAMPLES / 2 rows
        thresholds = dict.fromkeys((KINDS.index(k) for k in CANDIDATES), math.inf)
        real, n = dict.fromkeys(thresholds, 0.0), dict.fromkeys(thresholds, 0)
        for r in scores:
            k = r["kind"]
            real[k], n[k] = real[k] + r["real"], n[k] + r["n"]
            if real[k] >= PRECISION * n[k]:
                thresholds[k] = r["s"]
        _FITTED[app] = trees, thresholds
    return _FITTED[app]


def _complete(tree: list | float) -> dict[str, list]:
    """A tree as arrays over a complete binary tree of DEPTH: feature and limit of inner nodes, value of leaves.  Where it ends early all goes left."""
    f, limit, value = [0] * (2**DEPTH - 1), [1e300] * (2**DEPTH - 1), [0.0] * 2**DEPTH

    def put(t: list | float, at: int) -> None:
        if at >= len(f):
            value[at - len(f)] = t
        elif isinstance(t, list):
            f[at], limit[at] = t[0], t[1]
            put(t[2], 2 * at + 1)
            put(t[3], 2 * at + 2)
        else:
            put(t, 2 * at + 1)

    put(tree, 0)
    return {"f": f, "limit": limit, "value": value}


def margin(f: Column, trees: list[tuple[float, list]]) -> Column:
    """The trees' weighted sum for an array of FEATURES."""
    data = json.dumps([{"w": w, **_complete(t)} for w, t in trees])
    forest = F.from_json(F.lit(data), "array<struct<w:double,f:array<int>,limit:array<double>,value:array<double>>>")

    def leaf(t: Column) -> Column:
        down = lambda at, _: 2 * at + F.when(F.get(f, F.get(t["f"], at)) <= F.get(t["limit"], at), 1).otherwise(2)
        return F.get(t["value"], F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), down) - F.lit(2**DEPTH - 1))

    return F.aggregate(forest, F.lit(0.0), lambda total, t: total + t["w"] * leaf(t))


def spans(docs: DataFrame, text: str = "text", base: str = "pii_base", out: str = "pii") -> DataFrame:
    """docs with two arrays of (start, rank, end), sorted: base spans, and all spans; rank is the place in KINDS."""
    trees, thresholds = fit(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    shaped = lambda x, rank: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"))
    ranked = lambda k, of: F.transform(of, lambda x: shaped(x, F.lit(KINDS.index(k))))
    parts = [F.when(t.rlike("@" if k == "email" else "[0-9]"), ranked(k, F.filter(found(t, p), _valid(k)))).otherwise(none) for k, p in BASE.items()]

    proposed = F.array().cast("array<struct<rank:int,start:int,end:int,m:string>>")
    wide = lambda k, of: F.transform(of, lambda x: F.struct(F.lit(KINDS.index(k)).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m")))
    proposals = F.concat(*(F.when(t.rlike(gate), wide(k, found(t, p))).otherwise(proposed) for k, (p, gate) in CANDIDATES.items()))
    limits = F.array(*(F.lit(thresholds.get(r, math.inf)) for r in range(len(KINDS))))

    def chosen(x: Column) -> Column:
        def likely(c: Column) -> Column:
            before = between(x["chunks"], F.greatest(c["start"] - _BEFORE, F.lit(0)), c["start"])
            return let(features(c["m"], before, c["rank"]), lambda f: margin(f, trees)) >= F.get(limits, c["rank"])

        return F.transform(F.filter(x["all"], likely), lambda c: shaped(c, c["rank"]))

    more = let(proposals, lambda p: F.when(F.size(p) > 0, let(F.struct(chunks(t).alias("chunks"), p.alias("all")), chosen)).otherwise(none))
    return docs.withColumn(base, F.array_sort(F.concat(*parts))).withColumn(out, F.array_sort(F.concat(F.col(base), more)))


def written(c: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; spans that overlap become one."""
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    t = F.col("d")[text]

    def clean(x: Column) -> Column:
        covered = F.concat(F.array(F.lit(0)), running(F.transform(x["spans"], lambda s: s["end"]), largest=True))  # up to where, before each span and at last

        def piece(z: Column) -> Column:
            span = z["spans"]
            label = F.concat(between(x["chunks"], z["upto"], span["start"]), F.element_at(kinds, span["rank"] + 1))
            return F.when(span.isNull(), between(x["chunks"], z["upto"], x["n"])).when(span["start"] < z["upto"], "").otherwise(label)

        return F.array_join(F.transform(F.arrays_zip(x["spans"], covered.alias("upto")), piece), "")

    held = spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")).withColumn("t", t), "t", "base", "pii")
    new = F.when(F.size("pii") > 0, let(F.struct(F.col("pii").alias("spans"), chunks(F.col("t")).alias("chunks"), F.length("t").alias("n")), clean)).otherwise(t)
    return held.select(*(new.alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    # A second parameter of the lambda, even one with a default, would be the index of the span.
    count = lambda rank: F.size(F.filter("pii_base", lambda x: x["rank"] == rank)).cast("long")
    counts = [count(r).alias(f"n_{k}") for r, k in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))
