"""A corpus pipeline of training-data operators: from documents to packed sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import minhash, mixing, packing, pii, toxicity
from foliolake.llm.staging import release, stage
from foliolake.session import ship

#: Ids that are broadcast to take their documents out; with more, that join is shuffled.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; the lexicon is learnt from labels of documents here."""
    ship(spark)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, lexicon).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group, and all others that are in none.

    Rows that repeat a doc_id with its text are one document: the least of them stays.  Rows without a doc_id are
    grouped by an id made of their text, above 2 ** 62, so that a copy with an id of its own stays before them; their
    doc_id stays null.
    """
    ship(spark)
    made = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    named = docs.withColumn("name", F.coalesce(F.col("doc_id").cast("long"), made)).withColumn("hash", F.xxhash64("text"))
    groups = minhash.near_duplicates(named.select(F.col("name").alias("doc_id"), "text"))  # a staged table
    gone = stage(groups.where("not kept").select(F.col("doc_id").alias("name")).distinct(), "gone")
    bounded = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    left = named.join(bounded(gone), "name", "left_anti")
    # An id and a text's hash stand for a row, so that only rows that do repeat are brought together.
    repeats = stage(named.groupBy("name", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")
    if repeats.isEmpty():
        return left.select(*docs.columns)
    once = left.join(bounded(repeats), ["name", "hash"], "left_anti").select(*docs.columns)
    least = left.join(bounded(repeats), ["name", "hash"], "left_semi").groupBy("name", "hash").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(least.select("row.*"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars counted anew."""
    ship(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy."""
    ship(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        after = stage(function(spark, docs, sf_dir), name)
        release(docs)  # the table before, if it was a stage's
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: A tokenizer file decides the rows, which SQL cannot: tests hold run() against a brute-force version.
ORACLE_SQL = None
