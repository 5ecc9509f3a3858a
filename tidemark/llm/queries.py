"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chat import SQL_OP8, op8_chat_format
from tidemark.llm.dedup import op10_minhash_dedup
from tidemark.llm.langid import op7_language_id
from tidemark.llm.media import op6_webp_media
from tidemark.llm.mixture import SQL_OP3, op3_hierarchical_mix
from tidemark.llm.pieces import op2_merge_dropout
from tidemark.llm.quality import op5_robust_outliers
from tidemark.llm.sharding import SQL_OP9, op9_hash_tree_shards
from tidemark.llm.token_store import op1_token_store
from tidemark.llm.url_filter import SQL_OP4, op4_url_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_merge_dropout": op2_merge_dropout,
    "op3_hierarchical_mix": op3_hierarchical_mix,
    "op4_url_reputation": op4_url_reputation,
    "op5_robust_outliers": op5_robust_outliers,
    "op6_webp_media": op6_webp_media,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_hash_tree_shards": op9_hash_tree_shards,
    "op10_minhash_dedup": op10_minhash_dedup,
}
SQL: dict[str, str] = {
    "op3_hierarchical_mix": SQL_OP3,
    "op4_url_reputation": SQL_OP4,
    "op8_chat_format": SQL_OP8,
    "op9_hash_tree_shards": SQL_OP9,
}
