"""Queries of this subpackage by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from tractloom.llm import op1_embedding as op1, op2_quality_rules as op2, op8_chat as op8, op12_ranking as op12
from tractloom.llm.op3_url_filters import op3_url_filters
from tractloom.llm.op4_bpe import op4_bpe
from tractloom.llm.op5_packing import op5_packing
from tractloom.llm.op6_language import op6_language
from tractloom.llm.op7_toxicity import op7_toxicity
from tractloom.llm.op9_quality import op9_quality
from tractloom.llm.op10_simhash import op10_simhash
from tractloom.llm.op11_runs import op11_runs
from tractloom.llm.op13_substrings import op13_substrings

QUERIES = {f.__name__: f for f in (op1.op1_embedding, op2.op2_quality_rules, op3_url_filters, op4_bpe, op5_packing, op6_language, op7_toxicity, op8.op8_chat, op9_quality, op10_simhash, op11_runs, op12.op12_ranking, op13_substrings)}
ORACLE: dict[str, str] = {"op1_embedding": op1.SQL, "op2_quality_rules": op2.SQL, "op8_chat": op8.SQL, "op12_ranking": op12.SQL}
