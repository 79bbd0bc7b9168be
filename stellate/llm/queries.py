"""The training-data queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP4_SQL, op4_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op8_toxicity
from .warc import OP9_SQL, op9_warc
from .langid import op5_language_id
from .packing import op3_packing
from .pii import op6_pii
from .rollups import op7_token_rollups
from .simhash import op1_simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_token_rollups": op7_token_rollups,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
}
SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op4_decontaminate": OP4_SQL, "op9_warc": OP9_SQL, "op10_exact_dedup": OP10_SQL}
