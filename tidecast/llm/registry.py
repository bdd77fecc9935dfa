"""The queries of the training-data operators, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import context_tree, decontaminate, filter_audit, html_text, language_id, lexical_search, online_pack, pack, parity_join, quality_classifier, quality_rules, secret_scan, token_rollup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        language_id.op1_language_id,
        secret_scan.op2_secret_scan,
        pack.op3_best_fit_packing,
        token_rollup.op4_token_counts,
        html_text.op5_html_extraction,
        quality_rules.op6_quality_rules,
        quality_classifier.op7_quality_classifier,
        parity_join.op8_ngram_jaccard_join,
        decontaminate.op9_decontamination,
        context_tree.op10_lm_scoring,
        online_pack.op11_sum_of_squares_packing,
        filter_audit.op12_filter_audit,
        lexical_search.op13_ranked_search,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secret_scan.OP2_SQL,
        "op4_token_counts": token_rollup.OP4_SQL,
        "op8_ngram_jaccard_join": parity_join.OP8_SQL,
        "op9_decontamination": decontaminate.OP9_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_ranked_search": lexical_search.OP13_SQL,
    }
