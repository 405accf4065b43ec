"""Five stages from raw documents to packed sequences; each is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.llm import language, mixing, packing, quality, simhash
from shoalspark.llm.common import free_names, materialise, scratch_path, table
from shoalspark.llm.queries import BYTE_PIECES, tokenizer_path

#: Hashing, sampling and iterative stages: no SQL twin; the tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a letter, or far from every language's model, go."""
    return language.keep_identified(docs, language.train(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the base or a rule rejects go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each component the row of the least id stays, once; null ids come last, then the text's hash decides."""
    return simhash.keep_first(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document comes as many times as the mix takes it; extra columns may have any name."""
    row, of_row, copies, copy = free_names(docs, "mix_row", "of_row", "copies", "copy")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")  # ids may be null or repeat
    mixed = mixing.mix_sources(keyed.select("doc_id", "text", "source", F.col(row).alias("of_row")), row_col="of_row").where("copies > 0")
    taken = keyed.join(mixed.select(F.col("of_row").alias(of_row), F.col("copies").cast("int").alias(copies)), F.col(row) == F.col(of_row))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(row, of_row, copies, copy)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of full sequences."""
    return packing.pack(docs, tokenizer_path(BYTE_PIECES))


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
