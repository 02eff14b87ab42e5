"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import oracles
from .bpe import op3_byte_bpe
from .centroids import op13_centroids
from .conversations import op12_conversations
from .decontamination import op11_decontamination
from .html_text import op10_html_text
from .line_dedup import op7_line_dedup
from .packing import op5_packing
from .quality_grades import op8_quality_grades
from .quality_rules import op4_quality_rules
from .simhash import op1_simhash
from .suffix_dedup import op6_suffix_dedup
from .topk import op2_topk
from .toxicity import op9_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_topk": op2_topk,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_grades": op8_quality_grades,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "op11_decontamination": op11_decontamination,
    "op12_conversations": op12_conversations,
    "op13_centroids": op13_centroids,
}
ORACLES = {
    "op2_topk": oracles.OP2,
    "op4_quality_rules": oracles.OP4,
    "op5_packing": oracles.OP5,
    "op6_suffix_dedup": oracles.OP6,
    "op7_line_dedup": oracles.OP7,
    "op11_decontamination": oracles.OP11,
    "op12_conversations": oracles.OP12,
    "op13_centroids": oracles.OP13,
}
