"""Queries of this subpackage and their SQL."""

from . import alignment, bpe, decontaminate, digest_index, embedding, html_extract, jaccard_join, line_dedup, merkle, quality, sharding, token_files, warc

QUERIES = {
    "op1_bpe_speculate": bpe.op1_bpe_speculate,
    "op2_warc_round_trip": warc.op2_warc_round_trip,
    "op10_lstm_extract": html_extract.op10_lstm_extract,
    "op3_sampled_splitters": sharding.op3_sampled_splitters,
    "op4_qgram_lemma": decontaminate.op4_qgram_lemma,
    "op5_pivot_range_join": embedding.op5_pivot_range_join,
    "op6_huffman_ids": token_files.op6_huffman_ids,
    "op7_gbdt_quality": quality.op7_gbdt_quality,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_jaccard_pivots": jaccard_join.op9_jaccard_pivots,
    "op11_digest_index": digest_index.op11_digest_index,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op2_warc_round_trip": warc.OP2_SQL,
    "op5_pivot_range_join": embedding.OP5_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_jaccard_pivots": jaccard_join.OP9_SQL,
    "op11_digest_index": digest_index.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
