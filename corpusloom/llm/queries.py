"""The training-data queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, embed_dedup, licenses, mixing, packing, quality, simhash, suffix_dedup, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality": quality.op5_quality,
        "op6_topk": topk.op6_topk,
        "op7_mixing": mixing.op7_mixing,
        "op8_embed_dedup": embed_dedup.op8_embed_dedup,
        "op9_packing": packing.op9_packing,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.OP1_SQL, "op2_suffix_dedup": suffix_dedup.OP2_SQL, "op6_topk": topk.OP6_SQL, "op8_embed_dedup": embed_dedup.OP8_SQL}
