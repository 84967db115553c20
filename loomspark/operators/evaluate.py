"""Answer metrics, evidence recall and their aggregates."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T

METRICS = ["exact_match", "f1", "rouge1_f", "rouge2_f", "rougeL_f", "bleu1", "bleu2", "bleu3", "bleu4", "bert_f1", "meteor", "sbert_similarity"]
MODEL_METRICS = ["bert_precision", "bert_recall"]


def metrics(prediction: Column, reference: Column) -> Column:
    """A map of metric to value: 12 entries, 14 where both texts are given. Model-based ones are 0 without a model."""
    p, r = F.array_distinct(T.metric_tokens(prediction)), F.array_distinct(T.metric_tokens(reference))
    common, n, m = T.n_common(p, r).cast("double"), F.size(p), F.size(r)
    f1 = F.when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2.0 * common / (n + m))
    recall, precision = common / F.greatest(F.lit(1), m), common / F.greatest(F.lit(1), n)
    same = (F.lower(F.trim(prediction)) == F.lower(F.trim(reference))).cast("double")
    values = {"exact_match": same, "f1": f1, "rouge1_f": recall, "rougeL_f": recall, "bleu1": precision, "meteor": recall}
    full = F.create_map(*[x for name in [*METRICS, *MODEL_METRICS] for x in (F.lit(name), values.get(name, F.lit(0.0)))])
    none = F.create_map(*[x for name in METRICS for x in (F.lit(name), F.lit(0.0))])
    given = (F.coalesce(prediction, F.lit("")) != "") & (F.coalesce(reference, F.lit("")) != "")
    return F.when(given, full).otherwise(none)


def aggregate_metrics(rows: DataFrame) -> DataFrame:
    """mean, std (0 for one value), median, min, max and count of each metric, overall and by category, in one grouping-sets pass."""
    long = rows.select("category", F.explode("metrics").alias("metric", "value"))
    sets = long.groupingSets([["metric"], ["category", "metric"]], "category", "metric")
    return sets.agg(
        F.grouping("category").alias("overall"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.median("value").alias("median"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("count"),
    )


def evidence(gold: Column, retrieved: Column) -> Column:
    """hit_any, hit_all and the missed ids; no gold is no hit."""
    gold = F.coalesce(gold, F.array().cast("array<string>"))
    missed = F.array_except(gold, F.coalesce(retrieved, F.array().cast("array<string>")))
    some = F.size(gold) > 0
    return F.struct((some & (F.size(missed) < F.size(F.array_distinct(gold)))).alias("hit_any"), (some & (F.size(missed) == 0)).alias("hit_all"), missed.alias("missed"))


def evidence_counts(gold: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, n_gold, n_hit of each question with gold; both are query_id and note_id rows, counted, never gathered."""
    hits = gold.join(found.select("query_id", "note_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "note_id"], "left")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("_hit").alias("n_hit"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """By category: questions, those with gold, and hits."""
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit_any").alias("hit_any"), F.count_if("hit_all").alias("hit_all"), F.count_if(F.col("has_gold")).alias("has_gold")
    )


def judge_score(response: Column) -> Column:
    """1 for a judge's JSON score of 1 or a plain answer that says correct, yes or equivalent and not incorrect."""
    body = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.when(body != "", body))
    score = F.when(parsed.isNotNull(), F.coalesce(F.try_variant_get(parsed, "$.score", "int"), F.lit(0)))
    low = F.lower(F.coalesce(response, F.lit("")))
    plain = low.rlike(r"\b(correct|yes|equivalent)\b") & ~low.rlike(r"\bincorrect\b")
    return F.when(score.isNotNull(), (score == 1).cast("int")).otherwise(plain.cast("int"))


def bleu_scores(prediction: str, reference: str) -> tuple[float, float, float, float]:
    """BLEU of one to four grams over word tokens: a precision of 0 counts as 0.1 matches, and short predictions pay the brevity penalty."""
    # The weights of n-gram orders for each of the four scores.
    weights = [(1.0,), (0.5, 0.5), (0.33, 0.33, 0.33), (0.25, 0.25, 0.25, 0.25)]
    p, r = (re.findall(r"\w+|[^\w\s]", t.lower()) for t in (prediction, reference))
    if not set(p) & set(r):
        return 0.0, 0.0, 0.0, 0.0
    logs = []
    for n in range(1, 5):
        own, other = (Counter(zip(*(t[i:] for i in range(n)))) for t in (p, r))
        total = max(1, sum(own.values()))
        logs.append(math.log(((own & other).total() or 0.1) / total))
    penalty = 1.0 if len(p) > len(r) else math.exp(1 - len(r) / max(1, len(p)))
    return tuple(penalty * math.exp(sum(w * x for w, x in zip(ws, logs))) for ws in weights)


def bleu(rows: DataFrame, prediction: str, reference: str) -> DataFrame:
    """rows with bleu1 to bleu4 of two texts, nulls read as empty. Counting n-grams against each other is quadratic in expressions, so it runs on Arrow batches."""
    schema = rows.select("*", *[F.lit(0.0).alias(f"bleu{k}") for k in range(1, 5)]).schema

    def run(frames):
        for frame in frames:
            made = [bleu_scores(p or "", r or "") for p, r in zip(frame[prediction], frame[reference])]
            yield frame.assign(**{f"bleu{k + 1}": [m[k] for m in made] for k in range(4)})

    return rows.mapInPandas(run, schema)


def with_model_metrics(rows: DataFrame, measures: dict) -> DataFrame:
    """rows (prediction, reference, metrics) with the metrics that pretrained models give: name to a function of two lists of texts.

    Without a model a metric stays 0; each function runs on Arrow batches, and one that fails leaves its metric as it was.
    """

    def run(frames):
        for frame in frames:
            maps = [dict(m) for m in frame["metrics"]]
            for name, measure in measures.items():
                try:
                    values = measure(frame["prediction"].tolist(), frame["reference"].tolist())
                except Exception:  # the metric keeps its default
                    continue
                for m, v in zip(maps, values):
                    m[name] = float(v)
            yield frame.assign(metrics=maps)

    return rows.mapInPandas(run, rows.schema) if measures else rows


def qa_statistics(questions: DataFrame, images: DataFrame) -> DataFrame:
    """Questions of all samples: total, with pictured evidence, and their average, least and most in a sample.

    questions: sample_id, qa_id; images: sample_id, qa_id of those with pictured evidence.
    """
    marked = questions.join(images.select("sample_id", "qa_id").distinct().withColumn("pictured", F.lit(1)), ["sample_id", "qa_id"], "left")
    per = marked.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("pictured", F.lit(0))).alias("pictured"))
    return per.agg(F.sum("n").alias("total"), F.sum("pictured").alias("with_image"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def of_categories(rows: DataFrame, allowed: list[int]) -> DataFrame:
    """Questions of the allowed categories."""
    return rows.where(F.col("category").try_cast("int").isin(allowed))
