"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from tracewell.llm.decontamination import OP4_SQL, op4_decontamination
from tracewell.llm.language_id import op8_language_id
from tracewell.llm.lm_scoring import op9_lm_scoring
from tracewell.llm.mixing import OP3_SQL, op3_mixing
from tracewell.llm.near_duplicates import op10_near_duplicates
from tracewell.llm.periodic_runs import op13_periodic_runs
from tracewell.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from tracewell.llm.quality_classifier import op2_quality_classifier
from tracewell.llm.quality_rules import op5_quality_rules
from tracewell.llm.sharding import OP1_SQL, op1_sharding
from tracewell.llm.token_counts import op6_token_counts
from tracewell.llm.url_filter import OP7_SQL, op7_url_filter
from tracewell.llm.warc import OP12_SQL, op12_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_warc": op12_warc,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op1_sharding": OP1_SQL, "op3_mixing": OP3_SQL, "op4_decontamination": OP4_SQL, "op7_url_filter": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL}
