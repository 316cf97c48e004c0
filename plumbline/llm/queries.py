"""The queries of this subpackage by name. Each runs its operator with production parameters over whole tables."""

from __future__ import annotations

from . import fingerprints, langid, minhash, mixing, mtree, packing, quality, sharding, spans, toxicity

QUERIES = {
    "op1_exact_top_k": mtree.query,
    "op2_toxicity": toxicity.query,
    "op3_minhash_near_dedup": minhash.query,
    "op4_substring_dedup": spans.query,
    "op5_best_fit_packing": packing.query,
    "op6_source_mixing": mixing.query,
    "op7_language_id": langid.query,
    "op8_quality_classifier": quality.query,
    "op9_sharding": sharding.query,
    "op10_document_fingerprints": fingerprints.query,
}

ORACLE_SQL: dict[str, str] = {"op1_exact_top_k": mtree.ORACLE_SQL}
