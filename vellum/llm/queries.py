"""The queries opN_ of this subpackage and their SQL."""

from __future__ import annotations

from vellum.llm.decontaminate import op7_decontaminate
from vellum.llm.htmltext import op5_html
from vellum.llm.langid import op4_language
from vellum.llm.licenses import op2_licenses
from vellum.llm.neighbours import op1_neighbours
from vellum.llm.packing import op6_packing
from vellum.llm.pii import op3_pii
from vellum.llm.sharding import op10_sharding
from vellum.llm.simhash import op9_simhash
from vellum.llm.unigram import op8_token_counts

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_licenses": op2_licenses,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_html": op5_html,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {}
