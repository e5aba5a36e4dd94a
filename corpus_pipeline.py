"""Corpus pipeline: toxicity, line dedup, n-gram join, mixing, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir). All but the
last return the columns of ``documents``, whatever other names those have. Stages read
their input several times and number its rows; rows that don't come straight from files
are checkpointed first, so that numbers agree. Every stage takes null and empty texts,
null ids, repeated rows and tables without rows; what becomes of them is said for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from planframe.llm import bpe, linededup, mixing, ngramjoin, toxicity
from planframe.llm.common import arrow_limits, checkpoint, free_names, stable


def _set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names under free ones, and what gives back the columns as they were."""
    others = dict(zip(names, free_names(docs, *names), strict=True))
    aside = {c: others[c.lower()] for c in docs.columns if c.lower() in others}
    return docs.withColumnsRenamed(aside), lambda out: out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from ``labels``.

    Null and empty texts have the score of a text without words; repeated rows stay or go
    together, as equal texts have equal scores. Without labels nothing goes.
    """
    arrow_limits(spark)
    own, back = _set_aside(docs, "score")
    model = toxicity.train(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score(own, model, reject=0.5))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has; none left means it goes.

    Null and empty texts have no lines and stay; of repeated rows the first keeps its lines,
    by (id, row), null ids last.
    """
    arrow_limits(spark)
    own, back = _set_aside(docs, "n_lines", "n_removed")
    out = linededup.dedup_lines(own)
    left = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0
    kept = out.where((F.col("n_removed") == 0) | left)
    return back(kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, likeness 0.8): the least id.

    Null and empty texts are like nothing and stay; of repeated rows one stays; null ids
    count as the largest.
    """
    arrow_limits(spark)
    docs = stable(docs)
    (number,) = free_names(docs, "row")
    kept = ngramjoin.ngram_components(docs, width=5, percent=80).where("kept").select(F.col("row").alias(number))
    return docs.withColumn(number, F.monotonically_increasing_id()).join(kept, number, "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy a row.

    Null and empty texts have no words and are taken like the others of their source; a
    null source is a source; repeated rows are taken one by one.
    """
    x = mixing.mix(docs, carry=docs.columns).where("copies > 0")
    (copy,) = free_names(docs, "copy")
    return x.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, token_ids`` (ids as little-endian uint32).

    Null and empty texts have no ids; every row stays.
    """
    arrow_limits(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_once),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing", mixed),
    ("byte-level BPE", tokens),
]

#: Viterbi decoding and BPE merges are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
