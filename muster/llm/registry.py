"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from muster.llm.bpe import op1_byte_bpe
from muster.llm.chats import op13_chat_format
from muster.llm.idcoder import op9_token_files
from muster.llm.licenses import op2_license_scan
from muster.llm.linechunks import op10_line_dedup
from muster.llm.merkle import op12_merkle, oracle as merkle_sql
from muster.llm.neardup import op4_near_dedup
from muster.llm.negatives import op11_hard_negatives, oracle as negatives_sql
from muster.llm.packing import op5_packing
from muster.llm.quality import op3_quality
from muster.llm.toxicity import op8_toxicity
from muster.llm.urlfilter import op7_url_filter, oracle as url_filter_sql
from muster.llm.vptree import op6_nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_nearest": op6_nearest,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op9_token_files": op9_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_chat_format": op13_chat_format,
}
ORACLES: dict[str, str] = {
    "op7_url_filter": url_filter_sql(),
    "op11_hard_negatives": negatives_sql(),
    "op12_merkle": merkle_sql(),
}
