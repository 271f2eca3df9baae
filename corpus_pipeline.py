"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decoyscope.llm import decontaminate, jaccard_join, mixing, sharding, tokenizer_quality
from decoyscope.llm.common import stored


READ = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame) -> DataFrame:
    """What the operators read, and all other columns of the caller in one, so that no name an operator adds can meet theirs."""
    rest = [F.col(f"`{name}`") for name in docs.columns if name not in READ]
    return docs.select(*READ, F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"))


def _together(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(name) if name in READ else F.col("rest")[name].alias(name) for name in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the tokeniser-fertility rules."""
    return _together(tokenizer_quality.judged(_apart(docs)).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return _together(jaccard_join.representatives(_apart(docs)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages, and n_chars to match; a document that was nothing else goes."""
    found = decontaminate.find(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rest = found.where("n_hit = 0 or n_hit < n_words")
    cut = rest.withColumn("text", decontaminate.cut(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("rest", F.col("rest").withField("n_chars", length))
    return _together(cut, docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights; a column `topic` holds real topics."""
    topic = F.col("rest.topic").cast("string") if "topic" in docs.columns else None
    return _together(mixing.mix(_apart(docs), topic=topic).where("kept"), docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard each is written to."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination),
    ("mixing", mixture), ("sharding", shards),
]
ORACLE_SQL = None
"""The first stage reads public vocabularies, which SQL cannot; tests compare it with a brute-force run."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
