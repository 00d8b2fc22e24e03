"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from lakeline.llm import chat, clusters, decontaminate, html, langid, packing, phrases, quality, simhash, substrings, toxicity, urls, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_urls": urls.op2_urls,
    "op3_chat": chat.op3_chat,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_simhash": simhash.op5_simhash,
    "op6_warc": warc.op6_warc,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_html": html.op9_html,
    "op10_substrings": substrings.op10_substrings,
    "op11_clusters": clusters.op11_clusters,
    "op12_phrases": phrases.op12_phrases,
    "op13_toxicity": toxicity.op13_toxicity,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op2_urls": urls.oracle(),
    "op3_chat": chat.ORACLE,
    "op6_warc": warc.ORACLE,
    "op11_clusters": clusters.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
