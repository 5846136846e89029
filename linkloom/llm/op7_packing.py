"""Packing by power-of-two decomposition.

The ids of a document are cut into full pieces of MAX_LENGTH and then one piece for each binary digit
of the rest, longest first.  Every piece is a sequence of its own, sequences are numbered by length,
and so no sequence crosses documents and none needs padding: each length is a power of two.

Defined results: a null or empty text has one token, the closing id.  Repeated rows, and rows of one id
or none, are packed each on its own.  Sequences go by length, a hash of id and place, id, place, number
of tokens and checksum.  An empty table gives no piece.  Texts of any length are cut whole.  Clashing names of other
input columns don't matter, as only the id and the text are read.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.op8_tokens import REMEMBERED, byte_symbols, vocabulary
from linkloom.llm.tables import ranked, read, small_batches, stage

VOCABULARY, END_ID, MAX_LENGTH = "word_bpe_49k.json", 1, 2048
#: Buckets of pieces of one length in which sequences are numbered.
SPREAD = 4096
#: Words that can be encoded one by one: Latin letters that have no other normal form, then ASCII marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)").fullmatch
_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts as the vocabulary's library gives them, as little-endian 32-bit integers.

    White space only parts words here, so a text's ids are those of its words, which are remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(path))
        self.model = self.library.model
        self.spelling = dict(enumerate(byte_symbols()))
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, s: str) -> bytes:
        """Ids of a lower-case pre-token."""
        if (out := self.parts.get(s)) is None:
            spelled = s if s.isascii() else s.encode().decode("latin-1").translate(self.spelling)
            out = self.parts[s] = _packed([t.id for t in self.model.tokenize(spelled)])
        return out

    def word(self, w: str) -> bytes:
        if m := _PLAIN(w):
            return self.part(m[1].lower()) + self.part(m[2])
        return _packed(self.library.encode(w, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):  # normal forms may reach over white space
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        if len(self.known) + len(self.parts) > REMEMBERED:
            self.known, self.parts = {}, {"": b""}
        words, known = _words(text), self.known
        for w in [w for w in set(words) if w not in known]:
            known[w] = self.word(w)
        return b"".join(map(known.__getitem__, words))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker."""
    return Encoder(path)


def pieces(tokens: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a document of so many tokens: powers of two, none over `longest`."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _cutter(path: str, end_id: int, longest: int, keep_ids: bool):
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), *([("ids", pa.binary())] if keep_ids else [])]
    kind = "array<struct<" + ",".join(f"{n}:{'binary' if n == 'ids' else 'bigint'}" for n, _ in fields) + ">>"
    end = _packed([end_id])

    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            data = encoder(path).ids(x.as_py() or "") + end
            n, start, row = len(data) // 4, 0, []
            for length in pieces(n, longest):
                own = data[4 * start : 4 * (start + length)]
                row.append({"start": start, "length": length, "ids_crc32": zlib.crc32(own), "doc_tokens": n} | ({"ids": own} if keep_ids else {}))
                start += length
            rows.append(row)
        return pa.array(rows, pa.list_(pa.struct(fields)))

    return F.arrow_udf(cut, kind).asNondeterministic()


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, end_id: int = END_ID, longest: int = MAX_LENGTH, keep_ids: bool = True) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, ids (binary, if kept), sequence_id, offset.

    Without ids the pieces are staged.  With ids, which outweigh the texts, texts are encoded twice
    instead: once to count the pieces of each bucket, once for the pieces, which are shuffled once.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    def cut(ids: bool) -> DataFrame:
        return own.select("__key", F.explode(_cutter(path, end_id, longest, ids)("__text")).alias("p")).select("__key", "p.*")

    # Longest first; within a length in an order that only depends on the piece.
    spread = F.pmod(F.xxhash64("__key", "start"), F.lit(SPREAD))
    order = (F.lit(longest.bit_length()) - F.floor(F.log2("length") + 0.5)).cast("long") * SPREAD + spread
    narrow = cut(False)
    held = None if keep_ids else stage(narrow, "pieces")
    out = ranked(cut(True) if keep_ids else held, [], [F.col("__key"), F.col("start"), F.col("doc_tokens"), F.col("ids_crc32")], "sequence_id", bucket=order, rows=narrow if keep_ids else None)
    return out.select(F.col("__key").alias(key), "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else []), "sequence_id", F.lit(0).cast("long").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), keep_ids=False)
