"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from tabaudit.llm import collocations, decontaminate, html_extract, jaccard_join, langid, maxent_lm, merkle, packing, sharding, token_files, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_sharding": sharding.op3_sharding,
    "op4_packing": packing.op4_packing,
    "op5_token_files": token_files.op5_token_files,
    "op6_warc": warc.op6_warc,
    "op7_langid": langid.op7_langid,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_topk": topk.op10_topk,
    "op11_maxent_lm": maxent_lm.op11_maxent_lm,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_sharding": sharding.oracle_sql(),
    "op6_warc": warc.ORACLE,
    "op10_topk": topk.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
