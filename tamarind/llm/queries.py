"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, contamination, cover_tree, hmm, jaccard, language, line_dedup, packing, sharding, url_filter

QUERIES = {
    "op1_decontamination": contamination.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_packing": packing.op3_packing,
    "op4_chat": chat.op4_chat,
    "op5_language": language.op5_language,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_cover_tree": cover_tree.op7_cover_tree,
    "op8_hmm": hmm.op8_hmm,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_jaccard": jaccard.op10_jaccard,
}
SQL = {
    "op1_decontamination": contamination.SQL,
    "op4_chat": chat.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_cover_tree": cover_tree.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_jaccard": jaccard.SQL,
}
