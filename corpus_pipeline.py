"""The corpus pipeline: operators of loomspark.llm applied to documents one after another.

Each stage takes all that its predecessor kept and is written as Parquet to the shared
folder, from where the next one reads it; an executor that is lost costs no finished stage.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, decontaminate, jaccard, pii, toxicity
from loomspark.llm.queries import tokenizer_path
from loomspark.llm.shared import discard, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = "_toxicity"
    while out in docs.columns:
        out = "_" + out
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that of the smallest doc_id."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    redacted = pii.redact(docs, pii.Detector())
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of what they decode to."""
    results = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), results).select("doc_id", "lang", "source", *results)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("jaccard join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: Trained models decide the first and the fourth stage; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if last is not None:  # what the next stage was made from is no longer read
            discard(last)
        last = docs
    return docs
