"""Queries and DuckDB texts of the subpackage, by name."""

from __future__ import annotations

from . import chat, decontam, jaccard, language, media, packing, quality, sharding, substrings, warc

QUERIES = {
    "op1_perspective_rotation": chat.op1_perspective_rotation,
    "op2_quadratic_discriminant": quality.op2_quadratic_discriminant,
    "op3_parity_sketch_join": jaccard.op3_parity_sketch_join,
    "op4_spaced_seeds": decontam.op4_spaced_seeds,
    "op5_suffix_groups": substrings.op5_suffix_groups,
    "op6_nearest_centroid": language.op6_nearest_centroid,
    "op7_warc_index_first": warc.op7_warc_index_first,
    "op8_histogram_packing": packing.op8_histogram_packing,
    "op9_ogg_columns": media.op9_ogg_columns,
    "op10_feistel_sharding": sharding.op10_feistel_sharding,
}
ORACLE = {
    "op1_perspective_rotation": chat.OP1_SQL,
    "op7_warc_index_first": warc.OP7_SQL,
}
