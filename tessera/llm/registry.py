"""The queries of this subpackage, and their oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, crf, embedding_dedup, html, importance, language, line_dedup, mixing, packing, ranked, rules, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        crf.op1_quality_classifier,
        rules.op2_quality_rules,
        line_dedup.op3_line_dedup,
        token_counts.op4_token_counts,
        embedding_dedup.op5_embedding_near_dedup,
        mixing.op6_mixing_sources,
        simhash.op7_simhash_near_dedup,
        html.op8_html_extraction,
        language.op9_language_id,
        packing.op10_best_fit_packing,
        importance.op11_importance_resampling,
        chat.op12_chat_formatting,
        ranked.op13_ranked_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": rules.ORACLE_OP2,
    "op3_line_dedup": line_dedup.ORACLE_OP3,
    "op5_embedding_near_dedup": embedding_dedup.ORACLE_OP5,
    "op6_mixing_sources": mixing.ORACLE_OP6,
    "op11_importance_resampling": importance.ORACLE_OP11,
    "op12_chat_formatting": chat.ORACLE_OP12,
    "op13_ranked_search": ranked.ORACLE_OP13,
}
