"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP9_SQL, op9_decontamination
from .html_text import op5_html_text
from .language_id import op2_language_id
from .lm_scoring import op7_lm_scoring
from .packing import op10_best_fit_packing
from .periodic_runs import op11_periodic_runs
from .personal_data import OP12_SQL, op12_personal_data
from .secrets import OP3_SQL, op3_secret_scan
from .simhash import op8_simhash
from .substring_dedup import op6_substring_dedup
from .syncmers import op4_fingerprints
from .url_filters import OP1_SQL, op1_url_filters
from .whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_html_text": op5_html_text,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_personal_data": op12_personal_data,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": OP1_SQL,
    "op3_secret_scan": OP3_SQL,
    "op9_decontamination": OP9_SQL,
    "op12_personal_data": OP12_SQL,
}
