"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import cdc_dedup, imatch, langid, license_scan, mixing_cube, piece_sampling, quality_crf, sharding, simhash, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_substring_dedup": cdc_dedup.op2_substring_dedup,
    "op3_quality_rules": quality_crf.op3_quality_rules,
    "op4_simhash": simhash.op4_simhash,
    "op5_piece_sampling": piece_sampling.op5_piece_sampling,
    "op6_mixing": mixing_cube.op6_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_warc": warc.op9_warc,
    "op10_imatch": imatch.op10_imatch,
}
#: Where SQL can express the whole result.
ORACLES: dict[str, str] = {"op9_warc": warc.OP9_SQL, "op10_imatch": imatch.OP10_SQL}
