"""The queries of the training-data operators, and oracle SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .embeddings import op10_embeddings
from .html import op3_html
from .lexical import SEARCH_SQL, op12_search
from .lines import op8_lines
from .media import op9_media
from .mining import NEGATIVES_SQL, op13_negatives
from .mixing import op4_mixing
from .quality import op2_quality
from .shards import op11_shards
from .simhash import op7_simhash
from .urls import op1_urls
from .warc import op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": op1_urls,
    "op2_quality": op2_quality,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_lines": op8_lines,
    "op9_media": op9_media,
    "op10_embeddings": op10_embeddings,
    "op11_shards": op11_shards,
    "op12_search": op12_search,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op12_search": SEARCH_SQL,
    "op13_negatives": NEGATIVES_SQL,
}
