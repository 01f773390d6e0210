"""Queries of this subpackage, and SQL where SQL can express them."""

from . import chat, embeddings, fingerprints, html_text, langid, minhash, mixing, packing, quality, suffix_dedup

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_embedding_near_dedup": embeddings.op5_embedding_near_dedup,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_packing": packing.op8_packing,
    "op9_language_id": langid.op9_language_id,
    "op10_quality_classifier": quality.op10_quality_classifier,
}
ORACLE = {
    "op1_mixing": mixing.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op3_minhash_near_dedup": minhash.ORACLE,
    "op5_embedding_near_dedup": embeddings.ORACLE,
    "op7_document_fingerprints": fingerprints.ORACLE,
}
