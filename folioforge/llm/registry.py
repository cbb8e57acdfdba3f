"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .alignment import op11_alignment
from .decontamination import OP10_SQL, op10_decontamination
from .factor_machine import op13_quality_classifier
from .licenses import OP4_SQL, op4_license_scan
from .near_dup import op8_near_dup
from .packing import op6_best_fit_packing
from .quality import op2_quality_rules
from .sharding import op9_sharding
from .suffix_dedup import op1_suffix_dedup
from .token_files import op7_token_files
from .toxicity import op3_toxicity
from .url_filter import op5_url_filter
from .whitening import op12_embedding_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_files": op7_token_files,
    "op8_near_dup": op8_near_dup,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLE: dict[str, str] = {
    "op4_license_scan": OP4_SQL,
    "op10_decontamination": OP10_SQL,
}
