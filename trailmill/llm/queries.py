"""The queries of this subpackage and their SQL where SQL can express them."""

from trailmill.llm import bpe, decontaminate, line_dedup, lm_score, mixing, page_text, quality, repeats, resampling, sharding, shingle_join, token_counts, vector_codes

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_repeats": repeats.op2_repeats,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_shingle_join": shingle_join.op4_shingle_join,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_page_text": page_text.op6_page_text,
    "op7_sharding": sharding.op7_sharding,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality": quality.op10_quality,
    "op11_bpe": bpe.op11_bpe,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_quality": quality.OP10_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_resampling": resampling.OP13_SQL,
}
