"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, line_dedup, ngram_join, piece_network, quality_classifier, quality_rules, sentencepiece_codec, spelling, token_counts, warc, whitening

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_ngram_join": ngram_join.query,
    "op3_token_counts": token_counts.query,
    "op4_warc": warc.query,
    "op5_line_dedup": line_dedup.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_lm_scoring": piece_network.query,
    "op8_quality_rules": quality_rules.query,
    "op9_sentencepiece": sentencepiece_codec.query,
    "op10_decontaminate": decontaminate.query,
    "op11_spelling_variants": spelling.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_embedding_whitening": whitening.query,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": chat_format.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op12_exact_dedup": exact_dedup.ORACLE_SQL}
