"""The text operators as queries over the given tables, with SQL where SQL can state the result."""

from .align import op13_token_alignment
from .exact import OP5_SQL, op5_exact_dedup
from .fingerprints import op4_fingerprints
from .html import op8_main_text
from .language import op1_language_id
from .lines import OP3_SQL, op3_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .near import op6_jaccard_join
from .pieces import op9_sentencepiece
from .pii import op10_personal_data
from .rules import OP11_SQL, op11_quality_rules
from .search import OP12_SQL, op12_lexical_search
from .suffixes import op2_suffix_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_main_text": op8_main_text,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_personal_data": op10_personal_data,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {"op3_line_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_mixing": OP7_SQL, "op11_quality_rules": OP11_SQL, "op12_lexical_search": OP12_SQL}
