"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cdc import op5_substring_dedup
from .chat import op3_chat_format
from .embed_dedup import op2_embedding_dedup
from .license_scan import op1_license_scan
from .mil import op13_quality_classifier
from .minhash import op6_minhash
from .lm import op4_lm_score
from .merkle import OP12_SQL, op12_merkle_manifest
from .mix import OP7_SQL, op7_mix
from .pieces import op9_sentencepiece
from .quality import op8_quality
from .records import op10_records
from .whiten import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_embedding_dedup, op3_chat_format, op4_lm_score, op5_substring_dedup, op6_minhash, op7_mix, op8_quality, op9_sentencepiece, op10_records, op11_whitening, op12_merkle_manifest, op13_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mix": OP7_SQL, "op12_merkle_manifest": OP12_SQL}
