"""A corpus in five stages: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of ``documents``.

Each row is scored, searched for leaks and packed by its own text, so rows of a null or repeated doc_id are rows like others there. Line
dedup takes rows that agree in doc_id and text for one document, and a null doc_id for a document of its own. Near dedup keeps every
row without an id and one row of each id that stays. Null texts are empty; they are never toxic, copies or leaks. Empty tables of
documents, labels or items give empty results, no terms and no leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontam, lines, minhash, packing, toxicity
from lakeloom.llm.common import Workspace, near
from lakeloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.5 or more go."""
    return toxicity.reject(spark, docs, toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only; every document stays, if with an empty text.

    The first occurrence stays so that one document of a large group of copies is whole for the next stage.
    """
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(spark, docs, min_docs=10, keep="first"))
    changed = F.col("n_dropped") > 0
    out = kept.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8) that of the smallest doc_id stays.

    Of several rows of one doc_id any one stays. The ids are broadcast while there are few (see ``near``), and then no text moves.
    """
    found = minhash.near_duplicates(spark, docs, words=5)
    out = docs.join(near(found.where("NOT kept").select("doc_id").distinct()), "doc_id", "left_anti")
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        out = out.join(near(again), "doc_id", "left_anti").unionByName(docs.join(near(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % or more of a benchmark item's five-word shingles go."""
    return decontam.reject(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_path(), words=700_000)  # beside what the stages before have left in memory


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_common_lines), ("near dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: A learned score and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return ws.finish(docs)
