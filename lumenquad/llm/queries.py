"""The queries of this subpackage, as __spark_entry__.py registers them, and SQL for those that SQL can express."""

from __future__ import annotations

from . import oracles
from .decontamination import op7_decontamination
from .html_extraction import op8_html_extraction
from .katz import op4_katz
from .merkle import op11_merkle_manifest
from .near_dedup import op3_near_dedup
from .ogg import op13_ogg_media
from .packing import op1_packing
from .quality_classifier import op2_quality_classifier
from .quality_rules import op10_quality_rules
from .sharding import op5_sharding
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op6_token_counts
from .whitening import op12_embedding_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_near_dedup": op3_near_dedup,
    "op4_katz": op4_katz,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_ogg_media": op13_ogg_media,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": oracles.NEAR_DEDUP,
    "op4_katz": oracles.KATZ,
    "op5_sharding": oracles.SHARDING,
    "op7_decontamination": oracles.DECONTAMINATION,
    "op9_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op10_quality_rules": oracles.QUALITY_RULES,
    "op11_merkle_manifest": oracles.MERKLE,
}
