"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .conversation_trie import op12_conversation_trie
from .jaccard import op11_jaccard
from .licenses import op1_licenses
from .line_crf import op4_line_crf
from .line_dedup import op8_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .quality_rules import op6_quality_rules
from .runs import op13_runs
from .secrets import op3_secrets
from .simhash import op9_simhash
from .token_files import op10_token_files
from .topk import OP7_SQL, op7_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_line_crf": op4_line_crf,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_topk": op7_topk,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_token_files": op10_token_files,
    "op11_jaccard": op11_jaccard,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_runs": op13_runs,
}
ORACLES: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op7_topk": OP7_SQL,
}
