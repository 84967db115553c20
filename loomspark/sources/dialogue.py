"""Dialogue data as tables: nested JSON in, notes and results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources import scratch

QA = "array<struct<question:string,answer:string,evidence:array<string>,category:int,adversarial_answer:string>>"
TURNS = "array<struct<speaker:string,dia_id:string,text:string,img_url:string,blip_caption:string,query:string>>"
SAMPLE = f"array<struct<qa:{QA},conversation:string,event_summary:string,observation:string,session_summary:map<string,string>>>"
#: Layout version of persisted notes and graphs; a table of another version is rebuilt.
VERSION = "1"


def samples(spark: SparkSession, path: str, ratio: float = 1.0) -> DataFrame:
    """One row for each element of a file's JSON array; sample_id is its place. A missing path fails as Spark's reader does.

    ratio below 1 keeps the first share of the samples, at least one.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", SAMPLE)).alias("sample_id", "s")).select("sample_id", "s.*")
    if ratio >= 1:
        return rows
    total = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * ratio)).alias("_n"))
    return rows.crossJoin(F.broadcast(total)).where("sample_id < _n").drop("_n")  # one row


def final_answer(category: Column, answer: Column, adversarial: Column) -> Column:
    return F.when(category == 5, adversarial).otherwise(answer)


def questions(rows: DataFrame) -> DataFrame:
    """One row for each question with its answer."""
    found = rows.select("sample_id", F.posexplode("qa").alias("qa_id", "q")).select("sample_id", "qa_id", "q.*")
    return found.withColumn("final_answer", final_answer(F.col("category"), F.col("answer"), F.col("adversarial_answer")))


def image_text(text: Column, img_url: Column, caption: Column) -> Column:
    """A turn's text with its picture's caption before it."""
    tag = F.concat(F.lit("[Image: "), caption, F.lit("]"))
    shown = F.coalesce(text, F.lit(""))
    return F.when(img_url.isNotNull() & caption.isNotNull(), F.when(shown != "", F.concat(tag, F.lit(" "), shown)).otherwise(tag)).otherwise(shown)


def turns(rows: DataFrame) -> DataFrame:
    """One row for each turn of each dated session; sessions without turns or date are left out."""
    keyed = rows.select("sample_id", F.from_json("conversation", "map<string,string>").alias("c"))
    sessions = keyed.select("sample_id", "c", F.explode("c").alias("key", "body")).where(F.col("key").rlike(r"^session_\d+$"))
    sessions = sessions.select(
        "sample_id", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), F.element_at("c", F.concat("key", F.lit("_date_time"))).alias("session_date"), F.from_json("body", TURNS).alias("t")
    ).where("coalesce(session_date, '') <> '' AND size(t) > 0")
    flat = sessions.select("sample_id", "session", "session_date", F.posexplode("t").alias("pos", "x")).select("sample_id", "session", "session_date", "pos", "x.*")
    return flat.select(
        "sample_id", "session", "session_date", "pos", "speaker", "dia_id", image_text(F.col("text"), F.col("img_url"), F.col("blip_caption")).alias("text"),
        F.col("blip_caption").alias("image_caption"), F.col("query").alias("image_query"),
    )


def image_evidence(qa: DataFrame, turns_: DataFrame, exact: bool = False) -> DataFrame:
    """Questions with a turn with a picture among their evidence. By default a turn matches on the part after the colon
    in any session; with exact, on the whole id."""
    wanted = qa.select("sample_id", "qa_id", F.explode("evidence").alias("e")).where(F.col("e").contains(":"))
    pictured = turns_.where("image_caption IS NOT NULL").select("sample_id", "dia_id")
    match = F.col("dia_id") == F.col("e") if exact else F.col("dia_id").endswith(F.element_at(F.split("e", ":"), -1))
    keyed = wanted.join(pictured, (wanted["sample_id"] == pictured["sample_id"]) & match, "left_semi")
    return keyed.select("sample_id", "qa_id").distinct()


def statistics(rows: DataFrame) -> DataFrame:
    """Samples, questions, sessions, turns and adversarial questions."""
    qa, t = questions(rows), turns(rows)
    q = qa.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("category") == 5).alias("adversarial"))
    s = t.agg(F.countDistinct("sample_id", "session").alias("sessions"), F.count(F.lit(1)).alias("turns"))
    return rows.agg(F.count(F.lit(1)).alias("samples")).crossJoin(q).crossJoin(s)  # single rows


def write_table(df: DataFrame, path: str, by: str | None = None, version: str = VERSION) -> None:
    """A persisted stage with its layout version; by names a partition column."""
    writer = df.withColumn("_version", F.lit(version)).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_partitions(df: DataFrame, path: str, by: str, version: str = VERSION) -> None:
    """Replace the partitions that df has rows of; all others stay as they are, file by file."""
    whole = df.withColumn("_version", F.lit(version)).repartition(by)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # no such table yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A persisted stage, or None where it is missing or of another version, so that the caller builds it anew."""
    df = _stored(spark, path)
    if df is None or "_version" not in df.columns or not df.where(F.col("_version") != VERSION).isEmpty():
        return None
    return df.drop("_version")


def stale(spark: SparkSession, path: str, keys: DataFrame, by: str, version: str = VERSION) -> DataFrame:
    """Of some keys those without a partition of this version: missing, of another version, or of several. Only the version column is read."""
    wanted = keys.select(by).distinct()
    df = _stored(spark, path)
    if df is None or "_version" not in df.columns:
        return wanted
    kept = df.groupBy(F.col(by).cast(keys.schema[by].dataType).alias(by)).agg(F.bool_and(F.col("_version") == version).alias("good")).where("good")
    return wanted.join(kept.select(by), by, "left_anti")


def load_or_build(spark: SparkSession, path: str, keys: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], version: str = VERSION, force: bool = False) -> DataFrame:
    """A stage kept by key: what is there of this version is loaded, what is stale is built (from a table of the keys) and replaces its own partitions alone.

    A key for which build makes no row has no partition and is built again the next time.
    """
    due = scratch.materialise(keys.select(by).distinct() if force else stale(spark, path, keys, by, version), "stale")
    if not due.isEmpty():
        write_partitions(build(due), path, by, version)
    df = _stored(spark, path)
    if df is None:
        return build(due).limit(0)
    own = df.withColumn(by, F.col(by).cast(keys.schema[by].dataType)).drop("_version")
    return own.join(keys.select(by).distinct(), by, "left_semi")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Every result file below a folder, one row each, with the path it came from and the model its name gives (what stands before _k<N>)."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(folder).withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_extract("path", r"([^/]+?)_k\d+[^/]*$", 1)
    return rows.withColumn("model", F.coalesce("model", name) if "model" in rows.columns else name)


def best_k(results: DataFrame, path_column: str = "path") -> DataFrame:
    """Of result files named ..._k<N>..., by model the k of the largest f1, ties to the smaller k."""
    keyed = results.withColumn("k", F.regexp_extract(path_column, r"_k(\d+)", 1).cast("int"))
    return keyed.groupBy("model").agg(F.max_by("k", F.struct("f1", -F.col("k"))).alias("best_k"), F.max("f1").alias("best_f1"))
