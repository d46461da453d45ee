"""Registered queries of the corpus operators over the whole ``documents`` table, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from slotledger.llm import (
    fingerprints, licenses, line_dedup, mixing, packing, quality, ranked, secrets, sharding, simhash, suffix_index, training_order, whitening,
)

QUERIES = {
    "op1_stratified_shards": sharding.query,
    "op2_training_order": training_order.query,
    "op3_line_dedup": line_dedup.query,
    "op4_scaled_sketch": fingerprints.query,
    "op5_license_scan": licenses.query,
    "op6_quality_outliers": quality.query,
    "op7_mixing": mixing.query,
    "op8_simhash": simhash.query,
    "op9_packing": packing.query,
    "op10_secret_scan": secrets.query,
    "op11_whitening": whitening.query,
    "op12_ranked_search": ranked.query,
    "op13_suffix_dedup": suffix_index.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_stratified_shards": sharding.ORACLE_SQL,
    "op5_license_scan": licenses.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op12_ranked_search": ranked.ORACLE_SQL,
}
