"""Corpus pipeline: documents to token ids in five stages.

quality rules -> SimHash near-dedup -> benchmark decontamination -> secret scan
-> SentencePiece encoding.  Each stage works on all that its predecessor kept;
all but the last return the columns of ``documents``.

In every stage a null text counts as empty, an empty table gives no rows, and
columns beside doc_id, text, lang and source pass through untouched whatever their
names.  Rows that repeat a doc_id are one document for a verdict; a row without
doc_id is named by its text.  Texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelens.llm import decontaminate, pieces, quality, secrets, simhash
from carelens.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: too short, too repetitive, or robust outliers."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    return secrets.redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the text, with the check of decoding them."""
    return pieces.encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

# The quality verdict (robust estimates), XXH64 and piece encoding have no SQL;
# tests/llm/test_language_pipeline.py recomputes near-duplicates and piece ids and
# takes the other verdicts from their operators, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared
    checkpoint folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
