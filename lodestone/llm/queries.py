"""The subpackage's queries, and DuckDB SQL for the one that SQL expresses."""

from __future__ import annotations

from . import decontam, lines, minhash, packing, quality_classifier, quality_rules, secrets, sharding, token_counts, toxicity

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_line_dedup": lines.query,
    "op3_quality_rules": quality_rules.query,
    "op4_toxicity": toxicity.query,
    "op5_token_counts": token_counts.query,
    "op6_packing": packing.query,
    "op7_sharding": sharding.query,
    "op8_minhash_near_dedup": minhash.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_benchmark_decontamination": decontam.query,
}

ORACLE_SQL = {"op7_sharding": sharding.oracle()}
