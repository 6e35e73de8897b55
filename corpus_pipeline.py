"""Corpus pipeline over documents: quality rules, near-duplicates, repeated passages, mixing, SentencePiece ids.

Every stage takes what the one before it kept and, but for the last, returns the columns of documents. SQL cannot express the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import cdc, minhash, mix, pieces, quality
from panelwright.llm.common import prepared, shared_path, without_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. A doc_id that repeats goes with all its rows if the rules reject one of them; rows with a null
    doc_id stay. Null languages and sources are groups of their own. An empty table gives an empty one; columns beyond those of documents are dropped."""
    prepared(spark)
    rejected = quality.quality_rules(docs).filter("not kept").select("doc_id")
    return without_ids(docs, rejected).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id.

    Null and empty texts are duplicates of nothing and stay, as do rows with a null doc_id; rows that repeat a doc_id are one document and
    stay or go together. An empty table gives an empty one."""
    prepared(spark)
    found = minhash.near_duplicates(docs, shingle=5, percent=80)
    return without_ids(docs, found.filter("not kept").select("doc_id")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id holds; documents of which nothing is left go.

    Untouched documents stay as they are, null and empty texts too, and rows with a null doc_id; rows that repeat a doc_id are one document.
    n_chars is counted anew (null for a null text). An empty table gives an empty one."""
    prepared(spark)
    left = cdc.substring_dedup(docs)
    whole = (F.col("removed_words") == 0) | (F.length(F.trim("text")) > 0)
    return left.filter(whole).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of the last one of a shard, the words that it takes.

    A text that is taken twice is two rows with one doc_id. Texts without words and rows with a null doc_id are not taken; ties of quotients and
    of seeded places fall by source and doc_id. A null source is a source of its own. An empty table gives an empty one."""
    prepared(spark)
    return mix.mixed_documents(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_ids, ids and whether decoding them gives the text.

    A null text counts as empty; of ways with equal scores one is taken, the same in every run. Repeated rows are encoded each, null ids and
    sources are kept. An empty table gives an empty one."""
    import public_tokenizers

    prepared(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.round_trip(docs.select("doc_id", "source", "text"), path)
    return both.select("doc_id", "source", pieces.id_count("ids", path).alias("n_ids"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
