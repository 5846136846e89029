"""Normal forms, tokens, codes and similarities, all as column expressions.

Every function takes and gives columns; nothing leaves the JVM.  Lengths and positions are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a whole token of a business name becomes.  Other legal forms stay as they are, and
#: forms written with dots fall apart into letters before this is applied.
LEGAL_FORMS = {
    "corporation": "corp",
    "incorporated": "inc",
    "company": "co",
    "limited": "ltd",
    "private": "pvt",
}
#: What a whole token of an address becomes.
ADDRESS_WORDS = {
    "street": "st",
    "road": "rd",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "lane": "ln",
    "highway": "hwy",
    "floor": "fl",
    "suite": "ste",
    "apartment": "apt",
    "building": "bldg",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
    "rue": "r",
    "chemin": "chem",
}
#: White space as Python has it; Java's own class lacks the separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: The widest relative difference in length at which edit similarity is still computed.
LENGTH_GATE = 0.6


#: Holds all characters that fold to several; four ranges are quick to test, a list of each is not.
_MAY_EXPAND = "[\u00bc-\u00be\u0132-\u0149\u01c4-\u01f3\u0587-\U0010ffff]"


@cache
def _folds() -> tuple[str, str, str, dict[str, str]]:
    """Characters that fold to one character, those characters, characters that vanish, and longer folds."""
    one_from, one_to, gone, many = [], [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:  # surrogates; Hangul follows a rule
            continue
        c = chr(cp)
        to = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if to == c:
            continue
        if not to:
            gone.append(c)
        elif len(to) == 1:
            one_from.append(c)
            one_to.append(to)
        else:
            many[c] = to
    return "".join(one_from), "".join(one_to), "".join(gone), many


def _hangul(c: Column) -> Column:
    """The letters of a Hangul syllable, by the rule of the Unicode standard."""
    leads, vowels, tails = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
    nth = F.ascii(c) - F.lit(0xAC00)
    at = lambda s, i: F.substring(F.lit(s), i.cast("int"), F.lit(1))
    tail = nth % 28
    return F.concat(at(leads, F.floor(nth / 588) + 1), at(vowels, F.floor(nth % 588 / 28) + 1), F.when(tail > 0, at(tails, tail)).otherwise(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it, also within its own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_unicode(c: Column) -> Column:
    """Compatibility decomposition without combining marks; null gives the empty string."""
    one_from, one_to, gone, many = _folds()
    # A constant list, found by a character's place in a constant string, keeps the plan small.
    keys, folds = "".join(many), F.split(F.lit("\x00".join(many.values())), "\x00")
    rare = _MAY_EXPAND

    def fold(x: Column) -> Column:
        return F.when(x.between("가", "힣"), _hangul(x)).otherwise(F.coalesce(F.get(folds, F.position(x, F.lit(keys)) - 1), x))

    def clean(c: Column) -> Column:
        expanded = F.when(c.rlike(rare), F.array_join(F.transform(F.split(c, ""), fold), "")).otherwise(c)
        return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(expanded, one_from + gone, one_to)).otherwise(c)

    return let(F.coalesce(c, F.lit("")), clean)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def tokens(normal: Column) -> Column:
    """The words of a normal form."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def _normal(c: Column, words: dict[str, str]) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(clean_unicode(c)), r"[^\p{L}\p{N}_]+", " "))
    if not words:
        return plain
    to = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    # Word by word only where one of the words is there.
    swapped = lambda p: F.array_join(F.transform(F.split(p, " "), lambda t: F.coalesce(F.try_element_at(to, t), t)), " ")
    return let(plain, lambda p: F.when(p.rlike(rf"(?:^| )(?:{'|'.join(words)})(?: |$)"), swapped(p)).otherwise(p))


def business_name(c: Column, normalize_suffixes: bool = True) -> Column:
    return _normal(c, LEGAL_FORMS if normalize_suffixes else {})


def address(c: Column, normalize_abbrevs: bool = True) -> Column:
    return _normal(c, ADDRESS_WORDS if normalize_abbrevs else {})


def numeric_anchors(c: Column) -> Column:
    """All whole numbers of a raw text, in order, repeats included."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.when(c.rlike(r"\p{Nd}"), found).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The distinct n-grams of a lower-cased text with a space at either end; a text shorter than n is its own gram."""

    def grams(padded: Column) -> Column:
        size = F.length(padded)
        return F.when(size == 2, F.array().cast("array<string>")).when(size < n, F.array(padded)).otherwise(let(F.split(padded, ""), windows))

    def windows(chars: Column) -> Column:
        part = lambda j: F.slice(chars, F.lit(j + 1), F.size(chars) - (n - 1))
        return F.array_distinct(reduce(lambda acc, j: F.zip_with(acc, part(j), lambda x, y: F.concat(x, y)), range(1, n), part(0)))

    return let(F.concat(F.lit(" "), F.lower(squeeze(c)), F.lit(" ")), grams)


def trigram_numbers(c: Column) -> Column:
    """The trigrams of char_ngrams as numbers, 21 bits a character: sets of numbers meet several times as fast as sets of strings."""

    def windows(codes: Column) -> Column:
        part = lambda j: F.slice(codes, F.lit(j + 1), F.size(codes) - 2)
        step = lambda x, y: x * (1 << 21) + y
        return F.array_distinct(F.zip_with(F.zip_with(part(0), part(1), step), part(2), step))

    def grams(padded: Column) -> Column:
        codes = F.transform(F.split(padded, ""), lambda x: F.ascii(x).cast("long"))
        return F.when(F.length(padded) == 2, F.array().cast("array<long>")).otherwise(let(codes, windows))

    return let(F.concat(F.lit(" "), F.lower(squeeze(c)), F.lit(" ")), grams)


def soundex(token: Column) -> Column:
    """First letter and three digits; any letter without a code parts equal codes, vowels or not."""
    up = F.upper(token)
    codes = F.translate(up, "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    codes = F.regexp_replace(codes, "[^1-6]", "0")
    body = F.replace(F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), F.lit(2), F.length(codes)), F.lit("0"), F.lit(""))
    return F.when(token.rlike(r"^\p{L}+$"), F.substring(F.concat(F.substring(up, 1, 1), body, F.lit("000")), 1, 4)).otherwise("")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap(a, b) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 at once if either is empty or lengths differ by more than LENGTH_GATE."""
    longer = F.greatest(F.length(a), F.length(b))
    gated = F.abs(F.length(a) - F.length(b)) / longer > LENGTH_GATE
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(gated, 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def parse_ids(c: Column) -> Column:
    """The ids of a comma-joined list, in order, repeats included."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def format_ids(ids: Column) -> Column:
    """Trimmed, without blanks and repeats, in order, comma-joined."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")), ",")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
