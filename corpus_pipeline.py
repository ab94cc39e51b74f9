"""Corpus pipeline: toxicity, near-dedup, decontamination, mixing, token output; each stage written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, minhash, mixing, tokenio, toxicity
from docloom.llm.common import id_fold, materialize, read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from labelled rows outside the held-out fold. Null and empty texts have no
    word to reject; repeated rows share a fate; no documents give no rows."""
    labels = read(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, toxicity.fit_on(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of Jaccard 0.8 or more on shingles of five words stays: the one with the smallest doc_id (a null one only
    in a group of nulls), of texts under that id the one with the smallest digest, of rows that repeat both the first. Rows are numbered as
    they are written, so null or repeated ids are no matter; null, empty and blank texts are in no group, so of those every row stays. An
    empty table gives no rows; all columns stay, whatever their names."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    doc_id, text = F.col("doc")["doc_id"], F.col("doc")["text"]
    key = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.md5(text).alias("digest"), "row")
    kept = minhash.near_duplicates(rows.select(key.alias("doc_id"), text.alias("text")), width=5, percent=80).where("kept")
    return rows.join(kept.select(F.col("doc_id")["row"].alias("row")), "row", "left_semi").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the rule of the decontamination operator, go."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times, or not at all. A null source is one; null texts weigh nothing;
    repeated rows are documents of their own; no documents give no rows."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in coded files in the shared folder; returns what reading them back gives of each document. A null text is an empty one,
    with the end id alone; null ids come first; no documents give no rows."""
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokenio.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenio.read_ids(spark, path, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: The classifier, the groups and the coder are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
