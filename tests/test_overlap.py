import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import graph, overlap


def brute(asked, held, k, earlier):
    out = {}
    for s, i, o, t in asked:
        found = [(-round(len(set(t) & set(u)) / len(set(t) | set(u)), 9), p, n) for r, n, p, u in held if r == s and set(t) & set(u) and (not earlier or p < o)]
        out[s, i] = [(n, -w) for w, p, n in sorted(found)[:k]]
    return {key: v for key, v in out.items() if v}


@pytest.mark.parametrize("k,earlier,rare", [(1, True, 3), (10, False, 3), (1, True, 200), (3, False, 0), (2, True, 5), (1, True, 0)])
def test_equals_brute_force(spark, k, earlier, rare):
    rng = random.Random(k + rare)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(40)]
    row = lambda s, i: (s, f"{s}-{i}", i, sorted({rng.choice(words[: rng.choice([3, 6, 43])]) for _ in range(rng.randrange(0, 9))}))
    held = [row(s, i) for s in (1, 2) for i in range(60)]
    asked = held if earlier else [row(s, i) for s in (1, 2, 3) for i in range(100, 140)]
    mine = spark.createDataFrame(asked, "sample_id long, ask_id string, ord long, tokens array<string>")
    theirs = spark.createDataFrame(held, "sample_id long, note_id string, ord long, tokens array<string>")
    got = {}
    for r in sorted(overlap.nearest(mine, theirs, k, earlier, rare).collect(), key=lambda r: r.place):
        got.setdefault((r.sample_id, r.ask_id), []).append((r.note_id, r.overlap))
    assert got == brute(asked, held, k, earlier)


def test_one_word_that_all_notes_share_makes_no_quadratic_table(spark):
    """100,000 notes of one sample share a word: the largest number of rows that any step makes stays linear."""
    n = 100_000
    notes = spark.range(n).select(F.lit(1).cast("long").alias("sample_id"), F.col("id").cast("string").alias("note_id"), F.col("id").alias("ord"), F.array(F.lit("all"), F.concat(F.lit("a"), (F.col("id") % 20_000).cast("string")), F.concat(F.lit("b"), "id")).alias("tokens"))
    best = graph.best_overlap(notes)
    assert best.count() == n - 1
    plan = best.groupBy().agg(F.count("*"), F.sum("overlap"))
    plan.collect()
    node = plan._jdf.queryExecution().executedPlan()
    rows, todo = [], [node.finalPhysicalPlan() if hasattr(node, "finalPhysicalPlan") else node]
    while todo:
        x = todo.pop()
        metric = x.metrics().get("numOutputRows")
        if metric.isDefined():
            rows.append(metric.get().value())
        children = x.children()
        todo += [children.apply(i) for i in range(children.size())]
        if x.nodeName().endswith("QueryStage"):
            todo.append(x.plan())
    assert rows and max(rows) < 25 * n, max(rows)
