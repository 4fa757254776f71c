"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat import OP10_SQL, op10_chat_preferences
from .exact import OP4_SQL, op4_exact_dedup
from .langid import op8_language_id
from .minhash import op1_minhash_near_dedup
from .mixing import op6_source_mixing
from .pii import op9_pii_surrogates
from .repeats import op3_suffix_array_dedup
from .tiling import op2_decontamination
from .toxicity import op5_toxicity
from .urls import op7_url_filter

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_chat_preferences": op10_chat_preferences,
}

ORACLE_SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op10_chat_preferences": OP10_SQL,
}
