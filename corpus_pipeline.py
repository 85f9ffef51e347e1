"""From documents to token ids: toxicity, near duplicates, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows to the shared folder and
gives the next stage what it reads back. All but the last return the columns of documents.

Nulls and empty texts pass every stage: a null text has no n-grams, no benchmark words, no spans and no ids, and is a
near duplicate of other texts without words. Rows that repeat an id are near duplicates of each other, of which one
stays. An empty table stays empty. Columns beyond those of documents pass up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spheric.llm import bpe, decontaminate, pii, simhash, toxicity
from spheric.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the classifier rejects goes. It learns from the labelled rows of all documents that aren't held out."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(every, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model=model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a Jaccard similarity of 0.8 or more in five-word shingles the row of the smallest id stays."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What holds a window of a benchmark item goes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds; n_chars follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" not in redacted.columns:
        return redacted
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids are little-endian 32-bit numbers."""
    import public_tokenizers

    out = bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: The classifier, the shingle sets and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
