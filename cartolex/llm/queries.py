"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontam import op1_decontamination
from .htmltext import op9_html_text
from .jaccard import OP4_SQL, op4_jaccard_join
from .kneser import op2_lm_score
from .langid import op7_language_id
from .packing import op3_packing
from .quality import OP5_SQL, op5_quality_rules
from .suffixdedup import op10_suffix_dedup
from .toxicity import op8_toxicity
from .warc import OP6_SQL, op6_warc

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_lm_score, op3_packing, op4_jaccard_join, op5_quality_rules, op6_warc, op7_language_id, op8_toxicity, op9_html_text, op10_suffix_dedup)}

#: Where SQL cannot express an operator (or not at this size), tests/llm holds it against brute force.
ORACLE_SQL = {"op4_jaccard_join": OP4_SQL, "op5_quality_rules": OP5_SQL, "op6_warc": OP6_SQL}
