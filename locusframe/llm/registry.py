"""The queries of this subpackage and, where SQL can state them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, language, lexical, lines, minhash, mixing, neighbours, sharding, simhash, substrings, token_counts, wavelet, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_vectors": neighbours.op1_near_vectors,
        "op2_minhash": minhash.op2_minhash,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_substrings": substrings.op5_substrings,
        "op6_mixing": mixing.op6_mixing,
        "op7_simhash": simhash.op7_simhash,
        "op8_sharding": sharding.op8_sharding,
        "op9_wavelet_tokens": wavelet.op9_wavelet_tokens,
        "op10_language_id": language.op10_language_id,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_whitening": whitening.op12_whitening,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": neighbours.ORACLE_SQL, "op2_minhash": minhash.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op8_sharding": sharding.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
