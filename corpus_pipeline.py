"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe, decontam, lines, minhash, toxicity
from tidewheel.runtime import remove, scratch, shared_folder, table

#: Words of a shingle and least similarity, in per cent, of near duplicates.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold. Null, empty and blank texts have the bias's score and stay; rows without
    doc_id and repeated rows are scored each; without labels everything stays; a score at the threshold goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of equal and near lines. Null, empty and blank texts and rows without doc_id
    stay as they are; repeated rows of one id and text keep the same lines; a text that loses all its lines goes."""
    return lines.drop_lines(docs, exact_chars=lines.EXACT_CHARS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Null, empty and blank texts and rows without
    doc_id link with nothing and stay; repeated rows of a kept id all stay."""
    return minhash.keep_first(docs, WORDS, PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay; repeated rows are judged each; items without
    tokens match nothing; an empty benchmark drops nothing."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row. Null and empty texts have no tokens; every row stays, repeated ones too."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("decontamination", drop_leaks),
    ("tokens", tokenize),
]

#: SQL can't express the trained model and the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stage outputs go to the shared folder of ``spark.checkpoint.dir``; a stage's tables and
    its predecessor's output are removed once it is written. An empty table goes through as one; very long texts count
    whole; columns beyond those of documents pass through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(path)
    return docs.select(*[F.col(c) for c in docs.columns])
