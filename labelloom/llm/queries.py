"""The registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from . import chat, decontamination, embedding_pairs, filter_audit, jaccard_join, lexical_search, licenses, line_spread, mixing, quality_model, quality_rules, secrets, token_shards

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_token_binary": token_shards.op2_token_binary,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat_format": chat.op6_chat_format,
    "op7_line_spread": line_spread.op7_line_spread,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_embedding_pairs": embedding_pairs.op13_embedding_pairs,
}
ORACLES = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op7_line_spread": line_spread.OP7_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_embedding_pairs": embedding_pairs.OP13_SQL,
}
