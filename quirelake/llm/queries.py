"""The corpus queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from quirelake.llm import centroids, decontaminate, jaccard, lines, packing, planes, quality, sharding, spelling, substrings, superkmers, toxicity, vectors
from quirelake.llm.oracles import ORACLES as ORACLES

QUERIES = {
    "op5_suffix_array_line_dedup": lines.op5_suffix_array_line_dedup,
    "pipeline": corpus_pipeline.run,
    "op2_signature_tree_join": jaccard.op2_signature_tree_join,
    "op3_column_wise_suffix_dedup": substrings.op3_column_wise_suffix_dedup,
    "op7_super_kmer_dedup": superkmers.op7_super_kmer_dedup,
    "op9_positional_index": decontaminate.op9_positional_index,
    "op1_noisy_or_toxicity": toxicity.op1_noisy_or_toxicity,
    "op8_compression_bands": quality.op8_compression_bands,
    "op6_plane_shuffled_ids": planes.op6_plane_shuffled_ids,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op10_bounded_ring_sharding": sharding.op10_bounded_ring_sharding,
    "op11_pigeonhole_spelling": spelling.op11_pigeonhole_spelling,
    "op12_exponion_clusters": centroids.op12_exponion_clusters,
    "op13_quantised_near_vectors": vectors.op13_quantised_near_vectors,
}
