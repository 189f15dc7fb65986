"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import chat_format, mixing, sharding
from tessel.llm.chat_format import op3_prefix_targets
from tessel.llm.grid_join import op6_epsilon_grid_join
from tessel.llm.jaccard_join import op4_ngram_jaccard
from tessel.llm.kneser_ney import op9_kneser_ney
from tessel.llm.mixing import op5_poisson_mixture
from tessel.llm.quality_rules import op7_crf_line_quality
from tessel.llm.sentence_pieces import op10_sentence_pieces
from tessel.llm.sharding import op1_tiered_shards
from tessel.llm.suffix_tree import op2_suffix_tree
from tessel.llm.token_counts import op8_token_counts

_ALL = (
    op1_tiered_shards, op2_suffix_tree, op3_prefix_targets, op4_ngram_jaccard, op5_poisson_mixture,
    op6_epsilon_grid_join, op7_crf_line_quality, op8_token_counts, op9_kneser_ney, op10_sentence_pieces,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op1_tiered_shards": sharding.ORACLE_SQL,
    "op3_prefix_targets": chat_format.ORACLE_SQL,
    "op5_poisson_mixture": mixing.ORACLE_SQL,
}
