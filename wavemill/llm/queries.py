"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import decontam, divergence, html, lexical, neardup, packing, pii, quality, sharding, substring, suffixes, toxicity, urls


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_packing": lambda s, d: packing.pack_documents(_table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op2_sharding": lambda s, d: sharding.digest(_table(s, d, "documents")),
    "op3_neardup": lambda s, d: neardup.near_duplicates(_table(s, d, "documents")),
    "op4_toxicity": lambda s, d: toxicity.digest(_table(s, d, "documents"), _table(s, d, "labels")),
    "op5_substring_dedup": lambda s, d: substring.digest(_table(s, d, "documents")),
    "op6_quality_rules": lambda s, d: quality.digest(_table(s, d, "documents"), _table(s, d, "labels")),
    "op7_html_extraction": lambda s, d: html.digest(_table(s, d, "pages")),
    "op8_pii": lambda s, d: pii.digest(_table(s, d, "documents")),
    "op9_url_filters": lambda s, d: urls.digest(_table(s, d, "pages")),
    "op10_decontamination": lambda s, d: decontam.digest(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op11_source_divergence": lambda s, d: divergence.source_divergence(_table(s, d, "documents")),
    "op12_suffix_dedup": lambda s, d: suffixes.digest(_table(s, d, "documents")),
    "op13_lexical_search": lambda s, d: lexical.search(_table(s, d, "documents"), _table(s, d, "benchmark")),
}

SQL = {"op3_neardup": neardup.SQL, "op5_substring_dedup": substring.SQL, "op9_url_filters": urls.SQL, "op11_source_divergence": divergence.SQL, "op12_suffix_dedup": suffixes.SQL, "op13_lexical_search": lexical.SQL}
