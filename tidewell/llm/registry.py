"""Queries and SQL of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from tidewell.llm import decontamination, exact_dedup, language_id, line_dedup, media, merkle, packing, quality, sentencepiece_codec, sharding, simhash, substring_dedup, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_media": media.op2_media,
    "op3_packing": packing.op3_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_simhash": simhash.op6_simhash,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
    "op11_whitening": whitening.op11_whitening,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op12_decontamination": decontamination.ORACLE}
