"""From raw documents to packed sequences, one operator of lakeops.llm per stage.

Each stage reads what the stage before it wrote. The first four return documents (all columns of their
input); the last returns the pieces of packed sequences. A null or empty text is a document like any
other: the first stage rejects it for having too few words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeops.llm import near_copies, packing, quality_model, quality_rules, secret_scan
from lakeops.llm.queries import digest_pieces
from lakeops.llm.registry import table
from lakeops.llm.shared import written
from lakeops.llm.vocabularies import WORD_BPE, path


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    return quality_rules.keep_passing(docs)


def is_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the best grade, neither low nor toxic, by a model of the labelled documents of the corpus."""
    model = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model, at_least=2, tail=model.cut)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. SimHash fingerprints at most 4 bits apart and bands of minima name
    the candidates; those link whose five-word shingles are alike by 0.8 or more."""
    return near_copies.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked, private keys with their bodies."""
    ledger = secret_scan.BlobLedger(spark, secret_scan.ledger_path(spark, "masked"), secret_scan.MASKED)
    return secret_scan.scan_and_redact(docs, ledger)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    return digest_pieces(packing.pack(docs, path(WORD_BPE), end_id=2, size=4096))


STAGES = [
    ("quality_rules", passes_rules),
    ("quality_classifier", is_good),
    ("simhash_near_dedup", one_per_group),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: The stages that learn or tokenize cannot be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to shared storage and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
