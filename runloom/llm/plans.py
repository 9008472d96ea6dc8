"""Queries of the llm operators and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.llm.context_mixing import op1_lm_scoring
from runloom.llm.conversations import op11_conversation_repair
from runloom.llm.crf_langid import op4_language_id
from runloom.llm.decontaminate import OP2_SQL, op2_decontaminate
from runloom.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from runloom.llm.html_text import op5_html
from runloom.llm.line_runs import op7_line_dedup
from runloom.llm.merkle import OP12_SQL, op12_merkle_manifest
from runloom.llm.mixing import op6_mixing
from runloom.llm.near_join import op10_ngram_jaccard_join
from runloom.llm.pii import op3_pii
from runloom.llm.toxicity import op13_toxicity
from runloom.llm.warc import op8_warc


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_decontaminate, op3_pii, op4_language_id, op5_html, op6_mixing, op7_line_dedup, op8_warc, op9_exact_dedup,
    op10_ngram_jaccard_join, op11_conversation_repair, op12_merkle_manifest, op13_toxicity, pipeline)}
ORACLE = {"op2_decontaminate": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op12_merkle_manifest": OP12_SQL}
