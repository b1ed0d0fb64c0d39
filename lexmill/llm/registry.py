"""Queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lexmill.llm import alignment, bpe, merkle, mixing, near_dedup, pii, quality_classifier, quality_rules, sharding, substring_dedup, toxicity, voronoi, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_voronoi_knn": voronoi.op7_voronoi_knn,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_sharding": sharding.op11_sharding,
    "op12_merkle": merkle.op12_merkle,
    "op13_alignment": alignment.op13_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_warc": warc.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op7_voronoi_knn": voronoi.ORACLE,
    "op10_near_dedup": near_dedup.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
