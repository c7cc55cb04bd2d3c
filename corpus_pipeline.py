"""A training corpus from `documents`: each stage reads what the stage before has kept.

Stages that filter or rewrite return the columns of their input. Rows are told apart by id and text, so rows that repeat
both stand for each other. SQL cannot express the trained and packed stages, so tests compare the stages with plain
versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmart.llm import decontaminate, jaccard, packing, pii, toxicity
from shelfmart.llm.common import table, tokenizer_path, written

ORACLE_SQL = None


def _sha() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _by_id_and_text(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join of rows with what was found for their id and text; nulls are equal."""
    right = found.withColumnRenamed("doc_id", "_id").withColumnRenamed("_sha", "_of")
    left = docs.withColumn("_sha", _sha())
    same = left["doc_id"].eqNullSafe(right["_id"]) & left["_sha"].eqNullSafe(right["_of"])
    return left.join(right, same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on them and `labels`, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; repeated rows once."""
    found = jaccard.join(docs.select("doc_id", "text", _sha().alias("_sha")), carry=("_sha",))
    kept = found.where("keep").select("doc_id", "_sha")
    return _by_id_and_text(docs, kept, "left_semi").dropDuplicates(["doc_id", "_sha"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by items of `benchmark`."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    found = pii.find(docs.select("doc_id", "text", _sha().alias("sha"))).withColumnRenamed("sha", "_sha")
    found = found.where(F.size("found") > 0).select("doc_id", "_sha", F.col("found").alias("_found"))
    joined = _by_id_and_text(docs, found.dropDuplicates(["doc_id", "_sha"]), "left")
    text = F.when(F.col("_found").isNotNull(), pii.masked(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    masked = joined.select("*", text.alias("_text"))
    n_chars = F.when(F.col("_found").isNotNull(), F.length("_text").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("_text").alias("text"), "n_chars": n_chars.alias("n_chars")}
    return masked.select(*[new.get(c, F.col(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
