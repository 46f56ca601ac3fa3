"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gantry.llm.chat_format import OP1_SQL, op1_perspective_rotation
from gantry.llm.decontamination import op6_decontamination
from gantry.llm.importance import OP11_SQL, op11_importance_resampling
from gantry.llm.line_dedup import OP5_SQL, op5_line_dedup
from gantry.llm.near_dedup import op3_near_dedup
from gantry.llm.packing import op8_best_fit_packing
from gantry.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from gantry.llm.quality_classifier import op4_quality_classifier
from gantry.llm.quality_rules import OP10_SQL, op10_quality_rules
from gantry.llm.secrets import op2_secret_scans
from gantry.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from gantry.llm.token_counts import op13_token_counts
from gantry.llm.url_filter import op7_url_filter


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_perspective_rotation, op2_secret_scans, op3_near_dedup, op4_quality_classifier, op5_line_dedup,
        op6_decontamination, op7_url_filter, op8_best_fit_packing, op9_substring_dedup, op10_quality_rules,
        op11_importance_resampling, op12_periodic_runs, op13_token_counts,
    )
    return {f.__name__: f for f in found}


def llm_sql() -> dict[str, str]:
    return {
        "op1_perspective_rotation": OP1_SQL, "op5_line_dedup": OP5_SQL, "op9_substring_dedup": OP9_SQL,
        "op10_quality_rules": OP10_SQL, "op11_importance_resampling": OP11_SQL,
        "op12_periodic_runs": OP12_SQL,
    }
