"""A training-corpus pipeline over documents: quality, near-duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents; the last returns the token ids.
Every stage's result is written as Parquet and read again, so that a lost executor costs a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.decontaminate import find_leaks
from tilewright.llm.minhash import near_duplicates
from tilewright.llm.piece_bpe import encode_decode
from tilewright.llm.quality import score, train
from tilewright.llm.secrets import scan_secrets
from tilewright.session import discard, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, COLUMNS).filter("predicted = 1").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; of rows of one id one stays. Rows without an id, which can't be told apart, all stay."""
    kept = near_duplicates(docs).filter("kept").groupBy("doc_id").agg(F.count("*").alias("rows"))
    named = docs.select(*COLUMNS).join(kept, "doc_id")
    several = named.filter("rows > 1").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return named.filter("rows = 1").select(*COLUMNS).unionByName(several).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS).filter("not leaked").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span of the text replaced."""
    safe = scan_secrets(docs, ["doc_id", "lang", "source"], redact=True)
    return safe.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicate), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("piece encoding", pieces)]

#: SQL can't express what the first and last stages compute.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
            if before is not None:  # what a stage was made from isn't needed once it is written
                discard(before)
            before = docs
    return docs
