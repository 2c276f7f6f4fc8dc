"""The operators' queries over the tables of an input folder, and SQL for those that SQL can express."""

from __future__ import annotations

from slateledger.llm.decontam import OP5_SQL, op5_decontam
from slateledger.llm.exact import OP2_SQL, op2_exact_dedup
from slateledger.llm.html import op11_html
from slateledger.llm.langid import op6_language_id
from slateledger.llm.packing import op9_packing
from slateledger.llm.pii import op10_pii
from slateledger.llm.quality import op7_quality
from slateledger.llm.resample import OP13_SQL, op13_resample
from slateledger.llm.simhash import op8_simhash
from slateledger.llm.spelling import OP12_SQL, op12_spelling
from slateledger.llm.substring import OP1_SQL, op1_substring_dedup
from slateledger.llm.suffix import OP4_SQL, op4_suffix_dedup
from slateledger.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontam": op5_decontam,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_html": op11_html,
    "op12_spelling": op12_spelling,
    "op13_resample": op13_resample,
}

ORACLE: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op5_decontam": OP5_SQL, "op12_spelling": OP12_SQL, "op13_resample": OP13_SQL}
