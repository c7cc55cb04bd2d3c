"""The registered queries of the operators and of the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from shelfmart.llm import oracles
from shelfmart.llm.decontaminate import op4_decontamination
from shelfmart.llm.grammar import op5_grammar_token_files
from shelfmart.llm.jaccard import op8_ngram_jaccard_join
from shelfmart.llm.manifest import op13_merkle_manifest
from shelfmart.llm.neighbours import op7_nearest_neighbours
from shelfmart.llm.orchard import op12_vector_codes
from shelfmart.llm.packing import op1_best_fit_packing
from shelfmart.llm.pii import op3_pii
from shelfmart.llm.secrets import op9_secret_scans
from shelfmart.llm.substrings import op2_suffix_dedup
from shelfmart.llm.tournament import op11_tournament_packing
from shelfmart.llm.toxicity import op10_toxicity
from shelfmart.llm.wordpieces import op6_token_counts

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_grammar_token_files": op5_grammar_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_secret_scans": op9_secret_scans,
    "op10_toxicity": op10_toxicity,
    "op11_tournament_packing": op11_tournament_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES = oracles.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
