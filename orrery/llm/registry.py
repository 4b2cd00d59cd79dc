"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import exact_dedup, lattice, line_dedup, ngram_join, packing, pii, sentencepiece, token_counts, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece.op1_sentencepiece,
    "op1_viterbi": sentencepiece.op1_viterbi,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_warc": warc.op4_warc,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_lattice": lattice.op7_lattice,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_lattice": lattice.ORACLE,
    "op10_pii": pii.ORACLE,
}
