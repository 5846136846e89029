"""Token counts by rank-synchronous array merging.

Pre-tokens are held together as one ragged numpy array of symbols.  In each round every sequence finds
its pair of lowest rank, all its occurrences are merged at once, left to right, and sequences without
a known pair are done; the count is the number of symbols that survive.  Words are counted once per
batch and remembered, so that only new ones are merged.

Defined results: a null or empty text has 0 bytes and 0 tokens.  Texts of any length are counted whole.
The special string of the vocabulary counts as one token wherever it stands, as the library has it by
default.  Rows are independent.  An input column named like the result is replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tables import read, small_batches

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Words whose counts a Python worker remembers (about 100 bytes each) before it starts anew.
REMEMBERED = 1_000_000
#: What the vocabulary's library takes for white space, and how it cuts text before merging.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NONE = np.int64(1 << 40)


def vocabulary(path: str) -> str:
    """Where a vocabulary lies: `path` itself if it has a folder, else the public file of that name."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merger:
    """Counts of symbols after all merges, for many pre-tokens at once."""

    def __init__(self, path: str) -> None:
        with open(vocabulary(path), encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.of_byte = np.array([ids[c] for c in byte_symbols()], np.int64)
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank
        self.cut = regex.compile(PATTERN)
        self.units = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def symbols(self, pieces: list[bytes]) -> np.ndarray:
        """For each non-empty piece, the number of symbols left when no pair can be merged."""
        left = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        own = np.arange(len(pieces))
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full(len(token), _NONE)  # of the pair that starts at a symbol; the last one of a piece has none
        if len(token) > 1:
            rank[:-1] = self.rank(token[:-1], token[1:])
        rank[np.cumsum(sizes) - 1] = _NONE
        while len(own):
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            if done.any():
                left[own[done]] = sizes[done]
                on = np.repeat(~done, sizes)
                token, rank, own, sizes, lowest = token[on], rank[on], own[~done], sizes[~done], lowest[~done]
                if not len(own):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            new_run = np.r_[True, np.diff(hit) != 1]  # of a pair that overlaps itself every other one merges
            run = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            token[hit] = self.merged[rank[hit]]
            rank[hit] = rank[hit + 1]  # _NONE where the merged symbol is now the last one
            stay = np.ones(len(token), bool)
            stay[hit + 1] = False
            piece = np.repeat(np.arange(len(own)), sizes)
            sizes = sizes - np.bincount(piece[hit], minlength=len(own))
            place = (np.cumsum(stay) - 1)[hit]
            token, rank = token[stay], rank[stay]
            ends = np.cumsum(sizes)
            last, first = np.zeros(len(token), bool), np.zeros(len(token), bool)
            last[ends - 1], first[ends - sizes] = True, True
            for at in (place[~last[place]], place[~first[place]] - 1):
                rank[at] = self.rank(token[at], token[at + 1])
        return left

    def learn(self, units: set[str]) -> None:
        new = list(units)
        cut = [self.cut.findall(u) for u in new]
        flat = [p.encode() for pieces in cut for p in pieces]
        if not flat:
            return
        total = np.add.reduceat(self.symbols(flat), np.cumsum([0, *(len(p) for p in cut[:-1])]))
        self.known.update(zip(new, total.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut, extra = [], []
        for text in texts:
            parts = self.at_special.split(text) if any(s in text for s in self.special) else [text]
            extra.append(len(parts) - 1)
            cut.append([u for part in parts for u in self.units.findall(part)])
        need = set().union(*cut)
        if len(self.known) + len(need) > REMEMBERED:
            self.known = {}
        self.learn({u for u in need if u not in self.known})
        get = self.known.__getitem__
        return [sum(map(get, units)) + more for units, more in zip(cut, extra, strict=True)]


@lru_cache(2)
def merger(path: str) -> Merger:
    """The merger of a Python worker."""
    return Merger(path)


def _counter(path: str):
    @F.arrow_udf("struct<n_bytes:bigint,n_tokens:bigint>")
    def counted(texts: pa.Array) -> pa.Array:
        values = [x or "" for x in texts.to_pylist()]
        sizes = [len(x.encode()) for x in values]
        counts, start, held = [], 0, 0
        for i, size in enumerate(sizes):  # by a few MB of text at a time
            held += size
            if held > 4_000_000 or i + 1 == len(values):
                counts += merger(path).count(values[start : i + 1])
                start, held = i + 1, 0
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["n_bytes", "n_tokens"])

    return counted.asNondeterministic()


def add_counts(docs: DataFrame, text: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """docs with a struct column `out`: n_bytes and n_tokens of each whole text."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, _counter(path)(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = add_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > LIMIT).alias("over_limit"))
