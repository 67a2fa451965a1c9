"""The corpus pipeline: from raw documents to token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives the columns of documents;
the last gives a row for each document copy as read back from the token files.

For all stages: a null text counts as empty; columns besides those of documents are carried along untouched, whatever
their names; an empty table gives an empty table; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, mixture, quality, simhash, tokens
from fieldloom.llm.common import cut, ship, table

#: Of the near-duplicate stage: similarity of sets of word shingles, and their words.
SIMILARITY, SHINGLE_WORDS = 0.8, 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.7 or more.

    Equal texts get equal scores, so repeated rows stay or go together, and no id or column decides; an empty or null text is one
    empty line and is scored as such; without usable labels every row gets one score (0.5, or the share of good labels).
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are linked by a similarity of 0.8 or more of their five-word shingles.

    The smallest doc_id stays, null ones last; ties are settled by digests of the text, then of the row.  Rows of one doc_id
    with different texts are different documents; repeated rows are one.  Texts without words are copies of each other.
    """
    ship(spark)
    return simhash.keep_one(docs, SIMILARITY, SHINGLE_WORDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which no benchmark item is covered by half or more.

    Equal texts stay or go together, whatever their doc_id, null included; an empty text stays; an empty benchmark takes nothing.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by their Poisson counts, in a global random order: that of the files and of the rows in them.

    A null source is one of its own; rows of one doc_id (null ones too) draw the same count and lie next to each other copy by copy.
    """
    ship(spark)
    return mixture.mix(docs, added=False)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from token files that keep the order of the rows' files.

    docs that don't come from files are written first.  An empty or null text is its end id alone; repeated rows and null doc_ids
    are rows like any other.
    """
    ship(spark)
    return tokens.token_table(*in_file_order(docs))


def in_file_order(docs: DataFrame) -> tuple:
    """(docs, path, tokenizer, end id, order) for token_table: the number of a row's file, its name, and the place in it."""
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        docs = cut(docs, "token-input")
    name = F.col("_metadata.file_name")
    return docs, None, None, 2, (F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index"))


STAGES = [
    ("quality", good_quality),
    ("near-duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixture", mixed_sources),
    ("tokens", token_files),
]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
