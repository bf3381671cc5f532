"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import sql
from .decontamination import op7_decontamination
from .fingerprints import op6_fingerprints
from .jaccard_join import op9_jaccard_join
from .line_dedup import op8_line_dedup
from .lm_scoring import op2_lm_scoring
from .packing import op5_packing
from .quality import op10_quality
from .secrets import op3_secrets
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op1_suffix_dedup


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_secrets": op3_secrets,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_packing": op5_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_decontamination": op7_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": sql.OP1, "op3_secrets": sql.OP3, "op4_substring_dedup": sql.OP4, "op9_jaccard_join": sql.OP9}
