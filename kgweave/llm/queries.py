"""Registered queries of the subpackage."""

from __future__ import annotations

from kgweave.llm import decontaminate, fertility, fim, hnsw, licenses, lloyd, mixing, ngram_join, quality, secrets, tokens, url_rules, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_neighbours": hnsw.op3_neighbours,
    "op4_warc": warc.op4_warc,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op5_ngram_links": ngram_join.op5_ngram_links,
    "op6_url_rules": url_rules.op6_url_rules,
    "op7_mixture": mixing.op7_mixture,
    "op8_secrets": secrets.op8_secrets,
    "op9_contamination": decontaminate.op9_contamination,
    "op10_licenses": licenses.op10_licenses,
    "op11_fim": fim.op11_fim,
    "op12_fertility": fertility.op12_fertility,
    "op13_clusters": lloyd.op13_clusters,
}
ORACLES = {
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op5_ngram_links": ngram_join.OP5_LINKS_SQL,
    "op6_url_rules": url_rules.OP6_SQL,
    "op7_mixture": mixing.OP7_SQL,
    "op9_contamination": decontaminate.OP9_SQL,
    "op11_fim": fim.OP11_SQL,
    "op12_fertility": fertility.op12_fertility,
    "op13_clusters": lloyd.OP13_SQL,
}
