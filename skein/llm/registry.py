"""The numbered queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import context_mixing, exact_dedup, hard_negatives, langid, minhash, mixing, packing, pieces, quality_model, quality_rules, resampling, secrets, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "quality_ablations": quality_rules.quality_ablations,
        "op2_quality_classifier": quality_model.op2_quality_classifier,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_minhash_near_dedup": minhash.op7_minhash_near_dedup,
        "op8_lm_score": context_mixing.op8_lm_score,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_language_id": langid.op10_language_id,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_sentencepiece": pieces.op13_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "quality_ablations": quality_rules.ABLATIONS_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op9_secret_scan": secrets.OP9_SQL,
        "op11_importance_resampling": resampling.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
    }
