"""The queries of this subpackage, by name, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .chat_format import OP11_SQL, op11_chat_format
from .language_id import op2_language_id
from .license_scan import op3_license_scan
from .line_dedup import OP4_SQL, op4_line_dedup
from .media import op6_media_columns
from .near_dedup import OP9_SQL, op9_near_dedup
from .packing import op5_packing
from .periodic_runs import op12_periodic_runs
from .pii import op7_pii
from .quality_rules import OP10_SQL, op10_quality_rules
from .suffix_dedup import op8_suffix_dedup
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_media_columns": op6_media_columns,
    "op7_pii": op7_pii,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_chat_format": op11_chat_format,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op9_near_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL, "op11_chat_format": OP11_SQL}
