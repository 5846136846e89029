"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from linkloom.llm import op1_quality, op2_pii, op3_sharding, op4_mixing, op5_hnsw, op6_warc, op7_packing, op8_tokens, op9_chat, op10_simhash

QUERIES = {
    "op1_quality": op1_quality.query,
    "op2_pii": op2_pii.query,
    "op3_sharding": op3_sharding.query,
    "op4_mixing": op4_mixing.query,
    "op5_hnsw": op5_hnsw.query,
    "op6_warc": op6_warc.query,
    "op7_packing": op7_packing.query,
    "op8_tokens": op8_tokens.query,
    "op9_chat": op9_chat.query,
    "op10_simhash": op10_simhash.query,
}

ORACLE_SQL = {
    "op1_quality": op1_quality.SQL,
    "op4_mixing": op4_mixing.SQL,
    "op5_hnsw": op5_hnsw.SQL,
    "op6_warc": op6_warc.SQL,
    "op9_chat": op9_chat.SQL,
}
