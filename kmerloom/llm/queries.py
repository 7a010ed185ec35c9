"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontaminate import OP7_SQL, op7_decontaminate
from .fingerprint import op8_fingerprint
from .language_model import op6_language_model
from .near_duplicates import OP9_SQL, op9_near_duplicates
from .quality import op2_quality
from .secrets import op3_secrets
from .sharding import op1_sharding
from .substrings import OP5_SQL, op5_substrings
from .token_counts import op10_token_counts


def queries() -> dict:
    ops = (op1_sharding, op2_quality, op3_secrets, op4_bpe, op5_substrings, op6_language_model, op7_decontaminate, op8_fingerprint, op9_near_duplicates, op10_token_counts)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op5_substrings": OP5_SQL, "op7_decontaminate": OP7_SQL, "op9_near_duplicates": OP9_SQL}
