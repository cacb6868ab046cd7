"""The queries of this subpackage and their SQL; operators that SQL cannot express have none."""

from __future__ import annotations

from . import decontamination, line_dedup, merkle, mixing, passages, pii, repair, simhash, substrings, token_counts, topk, toxicity, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_topk": topk.op3_topk,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_pii": pii.op7_pii,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_passages": passages.op10_passages,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_repair": repair.op12_repair,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op7_pii": pii.OP7_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
