"""Raw documents to encoded training data: quality rules, line dedup, near-dedup, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.bpe import decode_digests, encode_documents
from assaylake.llm.common import saved, table
from assaylake.llm.line_dedup import dedup_lines
from assaylake.llm.mixing import mix_documents
from assaylake.llm.quality import filter_quality
from assaylake.llm.near_text import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document only; n_chars follows the text."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that a document is taken, in the mix's order."""
    return mix_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to, for each row."""
    return decode_digests(encode_documents(docs))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixing), ("BPE", bpe)]

#: SQL can express neither the learnt thresholds, nor XXH64 fingerprints, nor BPE. tests/llm holds each stage's operator
#: against brute force or its SQL on its own, and run()'s last stage against the tokenizers library; not run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
