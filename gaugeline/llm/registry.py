"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from gaugeline.llm import bpe, hnsw, jaccard, line_dedup, packing, quality, sharding, toxicity, vafile, warc

QUERIES = {
    "op1_toxicity_knn": toxicity.op1_toxicity_knn,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_warc_fixity": warc.op3_warc_fixity,
    "op4_sharding": sharding.op4_sharding,
    "op5_vafile": vafile.op5_vafile,
    "op6_packing": packing.op6_packing,
    "op7_bpe": bpe.op7_bpe,
    "op8_hnsw": hnsw.op8_hnsw,
    "op9_quality_bradley_terry": quality.op9_quality_bradley_terry,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op3_warc_fixity": warc.OP3_SQL,
    "op5_vafile": vafile.OP5_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
