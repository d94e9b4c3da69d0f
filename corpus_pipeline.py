"""The corpus pipeline: documents without toxic ones, one of each group of near copies, no benchmark passages, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.decontaminate import remove_phrases
from waybill.llm.jaccard import jaccard_components, without_ids
from waybill.llm.packing import pack_documents
from waybill.llm.queries import table, word_tokenizer
from waybill.llm.storage import bounded_batches, free_name, stored
from waybill.llm.toxicity import score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is learned from the labelled rows among ``docs``.

    Null and empty texts hold nothing toxic and stay; columns of any name come back as they were.
    """
    bounded_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    own = [F.col(f"`{name}`") for name in docs.columns]
    names = free_name(docs.columns, "toxicity_score"), free_name(docs.columns, "toxicity_predicted")
    return score_documents(docs, model, names=names).where(F.col(names[1]) == 0).select(*own)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; documents without words are their own group.

    Rows that repeat one doc_id are one document; those with a null doc_id are kept.
    """
    bounded_batches(spark)
    copies = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return without_ids(docs, stored(copies, "near-copies"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur in the benchmark; those that are nothing else go.

    Null and empty texts hold no passage and stay as they are, and so do repeated rows without one.
    """
    bounded_batches(spark)
    return remove_phrases(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens, each from one document; a null or empty text is its end token alone."""
    bounded_batches(spark)
    packed = pack_documents(docs, word_tokenizer())
    return packed.select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", F.crc32("ids").alias("ids_crc32"), "ids"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

# Learned scores and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
