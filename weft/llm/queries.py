"""The llm queries and their SQL."""

from __future__ import annotations

from weft.llm import chat, class_lm, decontaminate, fill_middle, language, sentencepiece, sharding, simhash, substring_dedup, suffix_dedup, topk, url_filter, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_sharding": sharding.op9_sharding,
    "op10_simhash": simhash.op10_simhash,
    "op11_whitening": whitening.op11_whitening,
    "op12_class_lm": class_lm.op12_class_lm,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

ORACLE = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_suffix_array_dedup": suffix_dedup.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op5_chat_formatting": chat.SQL,
    "op6_exact_top_k": topk.SQL,
    "op8_url_filter": url_filter.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
