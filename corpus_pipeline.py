"""From raw documents to token files, in five stages over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
``documents``, but for the last, which returns a row for each document in the token files.

1. ``quality``: documents whose score is below 0.7 go.
2. ``near_duplicates``: of each group of alike texts the document of the least id stays.
3. ``decontamination``: documents that hold a benchmark item, whole or edited, go.
4. ``mixing``: documents are sampled towards target weights by source, language and form.
5. ``tokens``: the rest is written to token files and read back.

Null texts count as empty. Empty tables pass through all stages. Columns beyond those of
``documents`` are carried along until the last stage, whatever they are called. Repeated rows of equal id and text
become one row in ``near_duplicates``; the other stages treat each row alike and by itself. Rows of one id with unlike
texts are documents of their own. Ties: of texts that are alike the least id stays, of one id the text with the least hash; a score
of exactly 0.7 stays. Very long texts are read whole in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.session import scratch_table
from llm import decontaminate, mixing, quality_classifier, simhash, token_files
from llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_table(docs, scratch_table(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), by_word=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixed), ("tokens", tokens)]

# The classifier and the tokenizer have no SQL; tests/llm holds near duplicates and decontamination
# against brute force, the other stages against round trips, held-out labels and targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
