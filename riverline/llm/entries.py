"""Queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from riverline.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from riverline.llm.lattice_lm import op6_lattice_lm
from riverline.llm.line_dedup import OP7_SQL, op7_line_dedup
from riverline.llm.packing import op4_packing
from riverline.llm.quality import op3_quality
from riverline.llm.rules import op9_rules
from riverline.llm.simhash import op5_simhash
from riverline.llm.suffix_dedup import op2_suffix_dedup
from riverline.llm.toxicity import op1_toxicity
from riverline.llm.word_bpe import op8_word_bpe


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_suffix_dedup": op2_suffix_dedup, "op3_quality": op3_quality, "op4_packing": op4_packing, "op5_simhash": op5_simhash, "op6_lattice_lm": op6_lattice_lm, "op7_line_dedup": op7_line_dedup, "op8_word_bpe": op8_word_bpe, "op9_rules": op9_rules, "op10_exact_dedup": op10_exact_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op10_exact_dedup": OP10_SQL}
