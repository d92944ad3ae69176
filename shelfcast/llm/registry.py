"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from shelfcast.llm import chat_perspectives, decontamination, embedding_dedup, fill_in_middle, html_extraction, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, sharding, spelling_variants

QUERIES = {
    "op1_perspective_rotation": chat_perspectives.op1_perspective_rotation,
    "op2_rendezvous_shards": sharding.op2_rendezvous_shards,
    "op3_quality_ledger": quality_rules.op3_quality_ledger,
    "op4_diagonal_voting": license_scan.op4_diagonal_voting,
    "op5_cost_balanced_packing": packing.op5_cost_balanced_packing,
    "op6_positional_index": decontamination.op6_positional_index,
    "op7_word_first_backoff": language_id.op7_word_first_backoff,
    "op8_random_indexing": quality_classifier.op8_random_indexing,
    "op9_dart_minhash": near_dedup.op9_dart_minhash,
    "op10_site_template_removal": html_extraction.op10_site_template_removal,
    "op11_pivotal_grams": spelling_variants.op11_pivotal_grams,
    "op12_displacement_scatter": fill_in_middle.op12_displacement_scatter,
    "op13_random_projection_forest": embedding_dedup.op13_random_projection_forest,
    "quality_ablation": quality_rules.quality_ablation,
}
ORACLES = {
    "op1_perspective_rotation": chat_perspectives.SQL,
    "op3_quality_ledger": quality_rules.SQL,
    "op4_diagonal_voting": license_scan.SQL,
    "op6_positional_index": decontamination.SQL,
    "op12_displacement_scatter": fill_in_middle.SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
}
