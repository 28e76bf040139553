"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import op6_decontaminate
from tidemark.llm.licenses import op5_license_scan
from tidemark.llm.mixture import OP4_SQL, op4_mix_sources
from tidemark.llm.near_dedup import OP7_SQL, op7_near_dedup
from tidemark.llm.neighbours import op2_nearest
from tidemark.llm.quality import op3_quality
from tidemark.llm.suffix_dedup import OP1_SQL, op1_suffix_dedup
from tidemark.llm.tokens import op9_token_counts
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.url_filter import OP10_SQL, op10_url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_nearest": op2_nearest,
        "op3_quality": op3_quality,
        "op4_mix_sources": op4_mix_sources,
        "op5_license_scan": op5_license_scan,
        "op6_decontaminate": op6_decontaminate,
        "op7_near_dedup": op7_near_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_url_filter": op10_url_filter,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op4_mix_sources": OP4_SQL, "op7_near_dedup": OP7_SQL, "op10_url_filter": OP10_SQL}
