"""Queries and SQL of the ``llm`` operators, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import (
    centroid_clusters,
    chat_format,
    decontaminate,
    line_dedup,
    ngram_join,
    nn_descent,
    packing,
    pii_surrogates,
    prefix_trie,
    suffix_dedup,
    token_counts,
    toxicity,
    warc_revisit,
)

QUERIES = {
    "op1_pii_surrogates": pii_surrogates.op1_pii_surrogates,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_nn_descent": nn_descent.op6_nn_descent,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_warc_revisit": warc_revisit.op10_warc_revisit,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op10_warc_revisit": warc_revisit.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_centroid_clusters": centroid_clusters.OP13_SQL,
}
