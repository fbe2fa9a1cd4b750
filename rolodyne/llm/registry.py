"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .align import op13_alignment
from .ann import op4_neighbours
from .fim import OP11_FILL_MIDDLE, op11_fill_middle
from .hosts import OP12_HOST_RULES, op12_host_rules
from .langid import op9_langid
from .lines import op10_lines
from .multiset import op5_fingerprints
from .packing import op6_packing
from .pieces import op3_sentencepiece
from .quality import op7_quality
from .repeats import op1_substrings
from .simhash import op2_simhash
from .urls import op8_urls


def queries() -> dict:
    return {
        "op1_substrings": op1_substrings,
        "op2_simhash": op2_simhash,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_neighbours": op4_neighbours,
        "op5_fingerprints": op5_fingerprints,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_urls": op8_urls,
        "op9_langid": op9_langid,
        "op10_lines": op10_lines,
        "op11_fill_middle": op11_fill_middle,
        "op12_host_rules": op12_host_rules,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_middle": OP11_FILL_MIDDLE, "op12_host_rules": OP12_HOST_RULES}
