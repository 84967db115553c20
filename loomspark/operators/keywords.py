"""Keywords of texts of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T


def keywords(rows: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """key and keywords of each row: ASCII words of three or more letters, first seen, capitalised ones first.

    Words become rows and are counted before the shuffle, so a long text costs its words and no more. Rows
    that repeat a key, and null keys, stay rows of their own.
    """
    numbered = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    words = numbered.select("_key", "_row", F.posexplode_outer(F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(T.KEYWORD), F.lit(0))).alias("at", "word"))
    # stop words become nulls, so that each row stays to the end and is numbered in one pass alone
    counted = words.withColumn("low", F.when(~F.lower("word").isin(T.KEYWORD_STOP), F.lower("word")))
    first = counted.groupBy("_row", "_key", "low").agg(F.min(F.struct("at", "word")).alias("f"))
    ranked = F.struct((~F.col("f.word").rlike("^[A-Z]")).alias("plain"), F.col("f.at").alias("at"), "low")
    chosen = first.groupBy("_row", "_key").agg(F.array_sort(F.collect_list(F.when(F.col("low").isNotNull(), ranked))).alias("found"))
    return chosen.select(F.col("_key").alias(key), F.transform(F.slice("found", 1, most), lambda x: x["low"]).alias("keywords"))
