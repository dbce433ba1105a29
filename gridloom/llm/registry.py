"""The queries of this subpackage and their SQL."""

from gridloom.llm import bpe, chat, divergence, embedding_dedup, exact_dedup, filter_audit, katz, language_id, mixing, ngram_join, pii, sharding, url_filter

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_bpe": bpe.op4_bpe,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_lm_scoring": katz.op9_lm_scoring,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_pii": pii.op11_pii,
    "op12_divergence": divergence.op12_divergence,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
#: Only queries that SQL can express have an entry; the others are tested against brute force in tests/llm.
ORACLE = chat.ORACLE | ngram_join.ORACLE | url_filter.ORACLE | embedding_dedup.ORACLE | exact_dedup.ORACLE | divergence.ORACLE | filter_audit.ORACLE
