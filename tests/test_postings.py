import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import retrieval as R
from loomspark.sources.postings import Postings


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    pick = lambda lo, hi: sorted({words[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(lo, hi))})
    notes = [(i, pick(3, 25) + ([f"t{i // 100}"] * (i % 9 == 0))) for i in range(1500)]
    asked = [(q, pick(1, 4) + [f"t{q % 15}"]) for q in range(30)] + [(90, []), (91, ["nowhere"])]
    return spark.createDataFrame(notes, "note_id long, tokens array<string>").cache(), spark.createDataFrame(asked, "query_id long, tokens array<string>").cache()


def rows(df):
    return sorted((r.query_id, r.note_id, round(r.score, 5), r["rank"]) for r in df.collect())


def test_an_append_of_half_equals_a_build_of_all(spark, data, tmp_path):
    notes, asked = data
    whole, halves = Postings(spark, str(tmp_path / "a"), "idx_a"), Postings(spark, str(tmp_path / "b"), "idx_b")
    whole.build(notes.limit(10))
    whole.build(notes)
    halves.append(notes.where("note_id % 2 = 0"))
    halves.append(notes.where("note_id % 2 = 1"))
    want = rows(R.top_k(R.bm25(notes, asked), 5))
    assert rows(R.top_k(whole.bm25(asked), 5)) == want == rows(R.top_k(halves.bm25(asked), 5))
    halves.drop()
    again = Postings(spark, str(tmp_path / "b"), "idx_c")  # opened anew from its files
    assert rows(R.top_k(again.bm25(asked), 5)) == want


def test_postings_are_not_shuffled(spark, data, tmp_path):
    index = Postings(spark, str(tmp_path / "p"), "idx_plan")
    index.build(data[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.table("postings").join(index.terms(data[1]), "token")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "note_id" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    above = [line for line in lines[:at] if len(line) - len(line.lstrip(" :+-*()0123456789")) < depth]
    assert "Bucketed: true" in lines[at] and not any("Exchange" in line for line in above), plan


def test_bounds_skip_chunks_and_lose_nothing(spark, data, tmp_path):
    notes, asked = data
    index = Postings(spark, str(tmp_path / "c"), "idx_bounds", chunk=F.floor(F.col("note_id") / 50))
    index.append(notes.where("note_id < 700"))
    index.append(notes.where("note_id >= 700"))
    for k in (1, 3, 10):
        best, judged = index.top_k(asked, k)
        assert rows(best) == rows(R.top_k(R.bm25(notes, asked), k))
    scores = R.bm25(notes, asked).withColumn("chunk", F.floor(F.col("note_id") / 50)).groupBy("query_id", "chunk").agg(F.max("score").alias("score"))
    assert index.limits(asked).join(scores, ["query_id", "chunk"]).where("score > most + 1e-9").count() == 0
    skipped = index.top_k(asked, 1)[1].where("NOT scored").count()
    assert skipped > 0
