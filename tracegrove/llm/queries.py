"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracegrove.llm import mixing
from tracegrove.llm.conversation_repair import op12_tight_arcs
from tracegrove.llm.decontaminate import op7_winnowing
from tracegrove.llm.fingerprint import op1_imatch
from tracegrove.llm.licenses import op10_rare_token_index
from tracegrove.llm.line_dedup import op3_segment_join
from tracegrove.llm.near_dedup import op13_sequential_bayes
from tracegrove.llm.ngram_join import op2_bayes_join
from tracegrove.llm.quality import op8_quadratic_discriminant
from tracegrove.llm.secrets import op9_zstd_novelty
from tracegrove.llm.spelling import op11_qgram_index
from tracegrove.llm.substring_dedup import op5_interval_expansion
from tracegrove.llm.toxicity import op6_nnpu_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_bayes_join": op2_bayes_join,
    "op3_segment_join": op3_segment_join,
    "op4_sainte_lague": mixing.op4_sainte_lague,
    "op5_interval_expansion": op5_interval_expansion,
    "op6_nnpu_toxicity": op6_nnpu_toxicity,
    "op7_winnowing": op7_winnowing,
    "op8_quadratic_discriminant": op8_quadratic_discriminant,
    "op9_zstd_novelty": op9_zstd_novelty,
    "op10_rare_token_index": op10_rare_token_index,
    "op11_qgram_index": op11_qgram_index,
    "op12_tight_arcs": op12_tight_arcs,
    "op13_sequential_bayes": op13_sequential_bayes,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sainte_lague": mixing.SQL,
}
