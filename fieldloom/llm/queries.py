"""The registered query of each operator: (spark, sf_dir) -> DataFrame, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, mixture, passages, pii, quality, search, simhash, substrings, tokens, urlfilter
from fieldloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_search": search.query,
    "op3_quality": quality.query,
    "op4_decontaminate": decontaminate.query,
    "op5_substrings": substrings.query,
    "op6_pii": pii.query,
    "op7_url_filter": urlfilter.query,
    "op8_mixture": mixture.query,
    "op9_tokens": tokens.query,
    "op10_passages": passages.query,
}

ORACLES = {
    "op2_search": search.ORACLE,
    "op5_substrings": substrings.ORACLE,
    "op7_url_filter": urlfilter.ORACLE,
    "op8_mixture": mixture.ORACLE,
}
