"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame, which is written and read again before the next
stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geobucket.llm.common import stored, table
from geobucket.llm.containment import without_items
from geobucket.llm.guess_cost import redact_secrets
from geobucket.llm.probminhash import deduplicated
from geobucket.llm.quality import good_documents
from geobucket.llm.queries import tokenizer_file
from geobucket.llm.sentencepiece_sa import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some rule rejects go."""
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each near-duplicate class stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay."""
    return redact_secrets(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can't express the near-duplicate stage; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is a table in the shared folder.

    Rows with null or empty texts go in the first stage; columns besides those
    of documents, whatever their names, reach all but the last stage; an empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
