"""The queries of this subpackage and the SQL to check them by."""

from __future__ import annotations

from tenurelens.llm import archives, language_id, license_scan, line_dedup, merkle, mixing, neighbours, ngram_join, packing, spelling, token_counts, token_index, vector_dedup

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_language_id": language_id.query,
    "op3_packing": packing.query,
    "op4_archives": archives.query,
    "op5_line_dedup": line_dedup.query,
    "op6_license_scan": license_scan.query,
    "op7_token_index": token_index.query,
    "op8_neighbours": neighbours.query,
    "op9_vector_dedup": vector_dedup.query,
    "op10_mixing": mixing.query,
    "op11_token_counts": token_counts.query,
    "op12_spelling_variants": spelling.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLES = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op4_archives": archives.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op9_vector_dedup": vector_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
