"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, langid, line_dedup, lm_score, media, mixing, quality, rans, simhash, suffix, token_counts, trie, whitening

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_rans": rans.op2_rans,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_langid": langid.op6_langid,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_simhash": simhash.op9_simhash,
    "op10_media": media.op10_media,
    "op11_quality": quality.op11_quality,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {"op4_line_dedup": line_dedup.SQL, "op5_suffix_dedup": suffix.SQL, "op8_decontaminate": decontaminate.SQL, "op12_prefix_trie": trie.SQL}
