"""The registered queries of this folder, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.byte_bpe import op9_byte_bpe
from quire.llm.chosen_paths import op12_chosen_paths
from quire.llm.decontaminate import op4_decontaminate
from quire.llm.hard_negatives import ORACLE as HARD_NEGATIVES
from quire.llm.hard_negatives import op13_hard_negatives
from quire.llm.host_reputation import ORACLE as HOST_REPUTATION
from quire.llm.host_reputation import op3_host_reputation
from quire.llm.language import op6_language_id
from quire.llm.merkle import op11_merkle_manifest
from quire.llm.ngram_join import op7_ngram_join
from quire.llm.spot_signatures import op2_spot_signatures
from quire.llm.substrings import op5_substring_dedup
from quire.llm.token_counts import op8_token_counts
from quire.llm.token_files import op10_token_files
from quire.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_spot_signatures": op2_spot_signatures,
    "op3_host_reputation": op3_host_reputation,
    "op4_decontaminate": op4_decontaminate,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_counts": op8_token_counts,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_files": op10_token_files,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_chosen_paths": op12_chosen_paths,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op3_host_reputation": HOST_REPUTATION, "op13_hard_negatives": HARD_NEGATIVES}
