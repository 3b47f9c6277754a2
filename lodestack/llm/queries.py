"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, byte_bpe, exact_dedup, near_dedup, packing, piece_bpe, secrets, spelling, token_counts, token_files, toxicity, vector_codes, warc

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_token_counts": token_counts.query,
    "op3_best_fit_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_near_dedup": near_dedup.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_token_files": token_files.query,
    "op8_secret_scan": secrets.query,
    "op9_warc": warc.query,
    "op10_ann": ann.query,
    "op11_vector_codes": vector_codes.query,
    "op12_piece_bpe": piece_bpe.query,
    "op13_spelling_variants": spelling.query,
}

#: No SQL for base32, crc32 or for coding, learning and searching; op6 and op11 alone have an equivalent.
ORACLE_SQL = {"op6_exact_dedup": exact_dedup.SQL, "op11_vector_codes": vector_codes.SQL}
