"""One query for each operator of this package, and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corvane.llm import chat, configpack, editembed, html_extract, linededup, packing, periodic, pieces, pii, quality, repair, sharding, simhash
from corvane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pii": lambda s, d: pii.report(table(s, d, "documents")),
        "op2_line_dedup": lambda s, d: linededup.report(table(s, d, "documents")),
        "op3_simhash": lambda s, d: simhash.report(table(s, d, "documents")),
        "op4_edit_embedding": lambda s, d: editembed.report(table(s, d, "documents")),
        "op5_chat_format": lambda s, d: chat.report(table(s, d, "conversations"), public_tokenizers.path("byte_bpe_50k.json")),
        "op6_packing": lambda s, d: packing.pack(table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
        "op7_sharding": lambda s, d: sharding.assign(table(s, d, "documents")),
        "op8_quality": lambda s, d: quality.judge(table(s, d, "documents")),
        "op9_pieces": lambda s, d: pieces.report(table(s, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
        "op10_html_extract": lambda s, d: html_extract.report(table(s, d, "pages")),
        "op11_periodic_runs": lambda s, d: periodic.report(table(s, d, "documents")),
        "op12_conversation_repair": lambda s, d: repair.report(table(s, d, "conversations")),
        "op13_config_packing": lambda s, d: configpack.pack(table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINE_DEDUP,
    }


LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, x AS line,
         translate(trim(x, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), keys AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (keys.k IS NOT NULL AND l.doc_id <> keys.last) AS dropped
  FROM lines l LEFT JOIN keys ON l.k = keys.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
