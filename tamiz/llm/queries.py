"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from tamiz.llm.attribution import op6_token_counts
from tamiz.llm.crosstoken import op11_cross_tokenizer
from tamiz.llm.jaccard import OP7_SQL, op7_jaccard_join
from tamiz.llm.langid import op2_language_id
from tamiz.llm.lexical import OP12_SQL, op12_lexical_search
from tamiz.llm.machine import op13_quality_classifier
from tamiz.llm.mixing import op9_mixing
from tamiz.llm.packing import op1_best_fit_packing
from tamiz.llm.pii import op10_pii
from tamiz.llm.quality import op5_quality_rules
from tamiz.llm.topk import OP8_SQL, op8_top_k
from tamiz.llm.toxicity import op3_toxicity
from tamiz.llm.urls import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_top_k": op8_top_k,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_lexical_search": op12_lexical_search,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLE: dict[str, str] = {"op4_url_filter": OP4_SQL, "op7_jaccard_join": OP7_SQL, "op8_top_k": OP8_SQL, "op12_lexical_search": OP12_SQL}
