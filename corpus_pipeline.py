"""From documents to token ids: toxicity, line dedup, near dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a table; all but the
last return the columns of documents. A written table stands between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import bpe, linededup, neardup, simhash, tiling, toxicity
from reckon.llm.common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain finds toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.classify(docs, model, ["_rk_low", "_rk_toxic"])
    return scored.where(F.col("_rk_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which nothing but white space stays goes too."""
    out = linededup.dedup_lines(docs)
    return out.where("_rk_dead = 0 or text rlike '[^ \\\\t\\\\n\\\\r\\\\f]'").select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 or more of 5-word shingles stays, that with the least doc_id.

    Op5's covering SimHash proposes, MinHash bands propose what lies beyond its radius, exact sets decide.
    """
    return neardup.near_dedup(docs, simhash.RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    hits = tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.where(F.size("_rk_hits") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.bpe_digests(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near dedup", dedup_near), ("decontamination", decontaminate), ("bpe", encode)]
#: Trained models, fingerprints and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
