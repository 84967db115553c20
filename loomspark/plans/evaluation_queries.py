"""Evaluation: answer metrics, evidence recall, statistics and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import evaluate
from loomspark.operators import retrieval as R
from loomspark.plans import duck, retrieval_queries
from loomspark.plans.registry import Dealt, query, table
from loomspark.sources import dialogue

_PAIRS = "pr AS (SELECT conv_id, turn, role AS category, coalesce(text, '') AS prediction, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS reference FROM conversations)"
_SETS = f"""s AS (SELECT *, list_distinct({duck.metric("prediction")}) AS p, list_distinct({duck.metric("reference")}) AS r FROM pr),
m AS (SELECT conv_id, turn, category, prediction <> '' AND reference <> '' AS given, CAST(lower(trim(prediction)) = lower(trim(reference)) AS DOUBLE) AS same, len(list_intersect(p, r)) AS c, len(p) AS n, len(r) AS k FROM s),
v AS (SELECT conv_id, turn, category, given, CASE WHEN given THEN same ELSE 0.0 END AS exact_match, CASE WHEN NOT given OR c = 0 THEN 0.0 ELSE 2.0 * c / (n + k) END AS f1,
  CASE WHEN given THEN c / greatest(1, k) ELSE 0.0 END AS recall, CASE WHEN given THEN c / greatest(1, n) ELSE 0.0 END AS precision FROM m)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a prediction of the next one."""
    rows = table(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = rows.select("conv_id", "turn", F.col("role").alias("category"), F.coalesce("text", F.lit("")).alias("prediction"), F.coalesce(following, F.lit("")).alias("reference"))
    return both.select("conv_id", "turn", "category", evaluate.metrics(F.col("prediction"), F.col("reference")).alias("metrics"))


@query(f"WITH {_PAIRS}, {_SETS} SELECT conv_id, turn, exact_match, round(f1, 6) AS f1, round(recall, 6) AS rouge1_f, round(precision, 6) AS bleu1, round(recall, 6) AS meteor, CASE WHEN given THEN 14 ELSE 12 END AS n_metrics FROM v")
def qa_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda k: F.round(F.col("metrics")[k], 6).alias(k)
    return predictions(spark, sf_dir).select("conv_id", "turn", *map(value, ("exact_match", "f1", "rouge1_f", "bleu1", "meteor")), F.size("metrics").alias("n_metrics"))


@query(
    f"""WITH {_PAIRS}, {_SETS}, l AS (
SELECT category, 'exact_match' AS metric, exact_match AS value FROM v UNION ALL SELECT category, 'f1', f1 FROM v
UNION ALL SELECT category, unnest(['rouge1_f', 'rougeL_f', 'meteor']), recall FROM v UNION ALL SELECT category, 'bleu1', precision FROM v
UNION ALL SELECT category, unnest(['rouge2_f', 'bleu2', 'bleu3', 'bleu4', 'bert_f1', 'sbert_similarity']), 0.0 FROM v
UNION ALL SELECT category, unnest(['bert_precision', 'bert_recall']), 0.0 FROM v WHERE given)
SELECT category, metric, CAST(grouping(category) AS TINYINT) AS overall, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS count
FROM l GROUP BY GROUPING SETS ((metric), (category, metric))"""
)
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.aggregate_metrics(predictions(spark, sf_dir))
    return rows.select("category", "metric", "overall", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "min", "max")], "count")


_EVIDENCE = f"""WITH {duck.BM25}, top5 AS ({duck.top("bm25", 5)}), g AS (SELECT b.item_id AS query_id, t.doc_id AS note_id FROM benchmark b JOIN documents t ON contains(t.text, b.text)),
e AS (SELECT b.item_id AS query_id, count(g.note_id) AS n_gold, count(t.note_id) AS n_hit FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id LEFT JOIN top5 t ON t.query_id = g.query_id AND t.note_id = g.note_id GROUP BY b.item_id),
h AS (SELECT query_id, query_id % 3 AS category, n_gold > 0 AND n_hit > 0 AS hit_any, n_gold > 0 AND n_hit = n_gold AS hit_all, n_gold > 0 AS has_gold, n_gold - n_hit AS n_missed FROM e)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's gold documents against the first five that BM25 finds."""
    docs, asked = retrieval_queries.documents(spark, sf_dir), retrieval_queries.questions(spark, sf_dir)
    counts = evaluate.evidence_counts(retrieval_queries.gold(spark, sf_dir), R.top_k(R.bm25(docs, asked), 5))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(counts, "query_id", "left").fillna(0, ["n_gold", "n_hit"])
    some = F.col("n_gold") > 0
    return rows.select("query_id", (F.col("query_id") % 3).alias("category"), some.alias("has_gold"), (some & (F.col("n_hit") > 0)).alias("hit_any"), (some & (F.col("n_hit") == F.col("n_gold"))).alias("hit_all"), (F.col("n_gold") - F.col("n_hit")).alias("n_missed"))


@query(f"{_EVIDENCE} SELECT query_id, hit_any, hit_all, n_missed FROM h")
def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "hit_any", "hit_all", "n_missed")


@query(f"{_EVIDENCE} SELECT category, count(*) AS total, count(*) FILTER (hit_any) AS hit_any, count(*) FILTER (hit_all) AS hit_all, count(*) FILTER (has_gold) AS has_gold FROM h GROUP BY category")
def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.diagnostics(_hits(spark, sf_dir))


@query("SELECT role AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM conversations GROUP BY role")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("share"))  # one row


@query(
    """WITH p AS (SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS speakers, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id)
SELECT count(*) AS samples, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(asked) AS BIGINT) AS asked, round(avg(turns), 6) AS mean_turns, min(turns) AS least_turns, max(turns) AS most_turns FROM p"""
)
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))
    return per.agg(
        F.count(F.lit(1)).alias("samples"), F.sum("turns").alias("turns"), F.sum("asked").alias("asked"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.min("turns").alias("least_turns"), F.max("turns").alias("most_turns")
    )


@query(
    """WITH r AS (SELECT event_type AS model, 10 * (1 + user_id % 5) AS k, round(avg(value) / 1000.0, 2) AS f1 FROM events GROUP BY ALL)
SELECT model, CAST(arg_max(k, (f1, -k)) AS INT) AS best_k, max(f1) AS best_f1 FROM r GROUP BY model"""
)
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: the type is the model, one user in five a k, the mean value a score that ties."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), (10 * (1 + F.col("user_id") % 5)).alias("k")).agg(F.round(F.avg("value") / 1000.0, 2).alias("f1"))
    return dialogue.best_k(runs.select("model", "f1", F.concat(F.lit("r/x_k"), "k", F.lit(".json")).alias("path")))


JUDGED = Dealt("id int, response string, score int", [(1, '{"score": 1, "reason": "x"}', 1), (2, 'so {"score": 0}', 0), (3, "Yes, it is.", 1), (4, "incorrect", 0), (5, "That is correct but incorrect", 0), (6, "", 0), (7, None, 0), (8, "{bad json} equivalent", 1)], ("response",))


@query(f"SELECT conv_id, turn, score FROM {JUDGED.sql}")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's responses, each before a turn's text, against worked-out scores."""
    return JUDGED.deal(spark, sf_dir).select("conv_id", "turn", evaluate.judge_score(F.col("response")).alias("score"))


@query("SELECT CAST(o_orderpriority AS VARCHAR) AS category, o_orderstatus AS metric, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup shape of the catalog on a fact table."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("metric"), "o_totalprice")
    return orders.rollup("category", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
