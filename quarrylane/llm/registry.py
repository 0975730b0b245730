"""Queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quarrylane.llm import bpe, embedding_dedup, exact_dedup, html_extract, language_id, language_model, licenses, packing, periodic_runs, pii, simhash, spelling, token_counts

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_language_model": language_model.op6_language_model,
    "op7_pii": pii.op7_pii,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_language_id": language_id.op10_language_id,
    "op11_spelling": spelling.op11_spelling,
    "op12_html_extract": html_extract.op12_html_extract,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES = {"op1_license_scan": licenses.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE}
