"""Training-corpus pipeline: stages over ``documents``, each written and reread as the next one's input.

Null texts, languages and sources are values like others to every stage; an empty table gives empty
results; columns beyond COLUMNS are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import stored, table
from panelloom.llm.decontaminate import contaminated
from panelloom.llm.mixing import mixture
from panelloom.llm.near_dedup import near_duplicates
from panelloom.llm.token_codec import hub_encoder, read_tokens, vocabulary, write_tokens
from panelloom.llm.toxicity import fit, scored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score this much are toxic.
REJECT = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from every label, as nothing is held out here.

    A doc_id goes with all its rows if one of them is rejected; rows without doc_id stay.
    """
    model = fit(spark, docs, table(spark, sf_dir, "labels"), F.lit(True))
    rejected = scored(spark, docs, model).where(F.col("score") >= REJECT).select("doc_id").where("doc_id is not null").distinct()
    return docs.select(COLUMNS).join(rejected, "doc_id", "left_anti").select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays.

    Of rows that share a doc_id the one with the least text stays (a null text counts as greatest); rows
    without doc_id stay all.
    """
    gone = near_duplicates(spark, docs).where("not kept").select("doc_id").distinct()
    rows = docs.select(COLUMNS)
    least = F.min(F.struct(F.col("text").isNull(), *COLUMNS[1:])).alias("row")
    once = rows.where("doc_id is not null").groupBy("doc_id").agg(least).select("doc_id", *(F.col(f"row.{c}").alias(c) for c in COLUMNS[1:])).unionByName(rows.where("doc_id is null"))
    return once.join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat or re-parameterise a benchmark item go, with all rows of their doc_id; rows without one stay."""
    hit = contaminated(spark, docs, table(spark, sf_dir, "benchmark")).where("doc_id is not null").select("doc_id").distinct()
    return docs.select(COLUMNS).join(hit, "doc_id", "left_anti").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: rows, with or without doc_id, once for each epoch their leaf takes, the last one's end cut."""
    return mixture(spark, docs.select(COLUMNS)).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks written and read back: place, length and checksum of each document's ids."""
    return read_tokens(write_tokens(spark, docs, hub_encoder(vocabulary())))


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: The toxicity model is trained, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: (doc_id, start, n_tokens, ids_crc32)."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, name)
    return docs
