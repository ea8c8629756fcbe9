"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, langid, lattice, lm, mixing, ngram_join, pii, substring, toxicity


def queries() -> dict:
    return {
        "op1_lattice_dedup": lattice.op1_lattice_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_language_id": langid.op4_language_id,
        "op5_bpe": bpe.op5_bpe,
        "op6_substring_dedup": substring.op6_substring_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_pii": pii.op8_pii,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_lm_score": lm.op10_lm_score,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators learn a model or cut text in ways that SQL can't express."""
    return {
        "op1_lattice_dedup": lattice.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op9_ngram_join": ngram_join.OP9_SQL,
    }
