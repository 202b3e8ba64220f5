"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, jaccard_join, language, licenses, line_dedup, mixing, quality, toxicity

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality": quality.query,
    "op3_language": language.query,
    "op4_decontamination": decontaminate.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_html_text": html_text.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_line_dedup": line_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_licenses": licenses.query,
}
ORACLE = {
    "op4_decontamination": decontaminate.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
}
