"""The corpus pipeline: quality rules, near-copy removal, mixing, packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.llm import mixing, packing, quality, resemblance
from tarnbridge.llm.common import read, shared_dir
from tarnbridge.llm.queries import WEIGHTS, domain_of

#: Share of the tokens at hand that the mixture takes. One epoch: no document comes twice.
MIXTURE_SHARE, MIXTURE_EPOCHS = 0.9, 1
#: Jaccard similarity from which documents are near copies, and words in a shingle.
NEAR, SHINGLE = 0.8, 5


#: Columns that stages work with; others pass through them as one struct, so that no name clashes.
OWN = ("doc_id", "text", "lang", "source")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects.

    A null text has no words and is rejected; repeated rows are judged alike; without labels only the base rule holds.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, found by SimHash and held to NEAR of the shingles of SHINGLE words: the one with the smallest doc_id.

    Null ids come last, then content decides; texts without words are copies of each other; of repeated rows one stays.
    """
    return resemblance.drop_resembling(docs, NEAR, SHINGLE)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets of the domain-language-source tree take, in tokens of the next stage's tokenizer.

    Null languages and sources are leaves of their own; a null text has one token; repeated rows are rows of their own.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    held = docs.select(*OWN, F.struct(*others).alias("doc")) if others else docs.select(*OWN)
    counted = mixing.with_tokens(held, public_tokenizers.path("byte_bpe_50k.json"))
    mixed = mixing.mix(counted, domain_of(F.col("source")), WEIGHTS, share=MIXTURE_SHARE, max_epochs=MIXTURE_EPOCHS, tokens=F.col("__n_tokens"))
    return mixed.select(*[F.col(c) if c in OWN else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 1024 tokens. A null text is one token; repeated rows and null ids are documents of their own."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), as_crc=True)
    return packing.pack(pieces, tasks=packing.tasks_for(docs))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Tokenizer ids, hashes of word shingles and a learned list are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{id(docs)}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
