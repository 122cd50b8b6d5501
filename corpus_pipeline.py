"""A training corpus from `documents`: toxic texts go, one of each group of near-copies
stays, secrets are replaced, sources are mixed to target weights, and what is left is
packed into sequences.

Every stage works on all its predecessor kept and returns the columns of documents; the
last returns pieces. Between stages the table is written to the shared folder and read
again, so a lost executor costs one stage's work.

Defined cases: null texts count as empty and stay null where a stage keeps them;
repeated rows are near-copies of each other; documents with a null id are kept or
dropped like others; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketlab.llm import mixing, packing, secrets, simhash, toxicity
from basketlab.llm.common import table
from basketlab.llm.tokens import vocabulary
from basketlab.sources.scratch import materialize

#: tokens that mixing keeps, in percent of those it is given; no document is repeated,
#: since that would bring back copies that were removed
MIX_PERCENT = 90


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 1), trained on the labels, doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-copies (operator 10): five-word shingles,
    similarity 0.8 or more."""
    return simhash.keep_one(docs, 0.8, 5)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets found (operator 3) replaced by marks."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of domain, language and source buy (operator 2)."""
    return mixing.keep_mixed(docs, MIX_PERCENT)


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (operator 7)."""
    return packing.pack(packing.pieces(docs, vocabulary(packing.VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("secrets", replace_secrets),
    ("mixing", mix_sources),
    ("packing", pack_pieces),
]

#: a trained classifier and token ids are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
