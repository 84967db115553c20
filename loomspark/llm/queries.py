"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, decontaminate, jaccard, licences, neighbours, pii, quality, runs, secret_scan, spelling, token_files, toxicity, urls
from loomspark.llm.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    report = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        "contaminated",
        "n_longest",
        "longest_at",
    )


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the package of the files is not part of this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.duplicate_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = _table(spark, sf_dir, "labels")
    judged = quality.judge(docs, quality.train(docs, labels), labels)
    return judged.select("doc_id", "source", "lang", "evidence", "host_posterior", "path_posterior", "score", "keep")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"), pii.Detector())


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return token_files.ids_crc32(token_files.read(spark, folder), ["doc_id", "start", "n_tokens"])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    results = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), results).select("doc_id", *results)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.verdicts(licences.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.train()).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.detect(docs, ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"], rule=runs.planted)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.word_counts(docs, rule=spelling.misspelt))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Query]:
    found = (op1_decontaminate, op2_jaccard_join, op3_neighbours, op4_quality, op5_pii, op6_token_files, op7_bpe, op8_licences, op9_toxicity, op10_url_filter)
    return {f.__name__: f for f in (*found, op11_periodic_runs, op12_spelling_variants, op13_secrets)}


def oracle_sql() -> dict[str, str]:
    from loomspark.llm import oracle

    return oracle.SQL
