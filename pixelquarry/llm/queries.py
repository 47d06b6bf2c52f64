"""The queries of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline

from . import oracles
from .byte_bpe import op7_byte_bpe
from .decontaminate import op5_decontaminate
from .language_id import op8_language_id
from .near_dedup import op1_minhash_dedup
from .quality_classifier import op4_quality_classifier
from .quality_rules import op3_quality_rules
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .url_filter import op10_url_filter
from .warc import op2_warc

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontaminate": op5_decontaminate,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op2_warc": oracles.OP2_WARC, "op6_substring_dedup": oracles.OP6_SUBSTRING_DEDUP, "op9_suffix_dedup": oracles.OP9_SUFFIX_DEDUP}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
