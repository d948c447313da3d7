"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontamination import op8_decontamination
from .exact_substrings import op4_exact_substrings
from .jaccard import op10_jaccard_join
from .language import op2_language_id
from .lattice import op13_lm_scoring
from .packing import op5_packing
from .prefix_trie import op12_conversation_trie
from .quality_model import op3_quality_classifier
from .quality_rules import QUALITY_RULES_SQL, op6_quality_rules
from .secrets import op7_secret_scans
from .sharding import op1_sharding
from .transcripts import op9_chat_formatting
from .whitening import op11_embedding_whitening

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_exact_substrings": op4_exact_substrings,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scans": op7_secret_scans,
    "op8_decontamination": op8_decontamination,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_lm_scoring": op13_lm_scoring,
}
ORACLES = {
    "op6_quality_rules": QUALITY_RULES_SQL,
}
