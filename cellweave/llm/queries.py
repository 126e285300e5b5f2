"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    merkle,
    mixing,
    ngram_join,
    phrases,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    token_count,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exact_dedup.op1_exact_dedup,
        secrets.op2_secret_scan,
        html_text.op3_html_text,
        decontaminate.op4_decontaminate,
        suffix_dedup.op5_suffix_dedup,
        token_count.op6_token_count,
        ngram_join.op7_ngram_join,
        language_id.op8_language_id,
        sharding.op9_sharding,
        mixing.op10_mixing,
        simhash.op11_simhash,
        phrases.op12_phrases,
        merkle.op13_merkle_manifest,
    )
}

SQL: dict[str, str] = {**exact_dedup.SQL, **phrases.SQL, **merkle.SQL}
