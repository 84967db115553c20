import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import graph, lifecycle, writepath
from loomspark.plans import note_queries
from loomspark.streaming import arrivals

FOLDER = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNCERTAIN, SUPERSEDING = ("maybe", "might", "probably"), ("now", "currently", "instead", "changed")


def conversations(spark):
    """Turns as notes of their conversations; some speak of a change, some are unsure, levels and domains vary, and some are null."""
    rows = note_queries.notes(spark, FOLDER).where("sample_id < 40")
    n = F.col("sample_id") + F.col("ord")
    said = F.when(n % 5 == 1, F.concat("content", F.lit(" now"))).when(n % 7 == 2, F.concat(F.lit("maybe "), "content")).when(n % 5 == 3, F.concat("content", F.lit(" when I prefer"))).otherwise(F.col("content"))
    twice = rows.withColumn("content", said)
    again = twice.select(*[F.col(c) if c not in ("ord", "note_id") else (F.col("ord") + 100).alias("ord") if c == "ord" else F.concat("note_id", F.lit("b")).alias("note_id") for c in twice.columns])
    both = twice.unionByName(again)
    level = F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, "instance").otherwise("task")
    return both.select(
        "sample_id", "note_id", "ord", "content", T.memory_tokens(F.col("content")).alias("tokens"), (0.5 + (n % 5) / 10).alias("confidence"), level.alias("memory_level"), (n % 8 == 1).alias("provided"),
        F.array(F.concat(F.lit("k"), (n % 3).cast("string"))).alias("keywords"), F.array().cast("array<string>").alias("tags"), F.array(F.lit("General")).alias("domain_paths"),
    )


def plain(rows):
    """One note after another, each compared with every note before it."""
    out, memory = {}, {}
    for row in sorted(rows, key=lambda r: (r["sample_id"], r["ord"], r["note_id"])):
        notes = memory.setdefault(row["sample_id"], [])
        own, text = set(row["tokens"]), row["content"]
        instance = (row["memory_level"] or "instance") == "instance"
        scored = [(round(len(own & n["tokens"]) / len(own | n["tokens"]), 9), n) for n in notes if own & n["tokens"]]
        scored = sorted(scored, key=lambda x: -x[0])[:10]
        if instance and row["provided"]:
            scored = []
        best, note, action = (scored[0] if scored else (0, None)), None, "create_separate_memory"
        if scored and not instance:
            share, note = best
            both = f"{note['content']} {text}".lower()
            if any(m in text.lower() for m in lifecycle.UNCERTAIN):
                action = "mark_candidate_uncertain"
            elif share < 0.08:
                pass
            elif any(m in text.lower() for m in lifecycle.SUPERSEDING) and share >= 0.16:
                action = "overwrite_existing"
            elif sum(m in both for m in lifecycle.CONDITIONAL) >= 2:
                action = "refine_conditions"
            elif share >= 0.16:
                action = "append_detail"
        if action in ("overwrite_existing", "refine_conditions", "append_detail"):
            old = note["content"]
            note["content"] = text if action == "overwrite_existing" else f"{old} Also, under a different condition or context, {text}" if action == "refine_conditions" else old if text in old else f"{old} {text}"
            note["tokens"] = own if action == "overwrite_existing" else note["tokens"] | own
            note["version"] += 1
            note["evidence"].append(row["note_id"])
            note["keywords"] += [k for k in row["keywords"] if k not in note["keywords"]]
            note["confidence"] = max(note["confidence"], row["confidence"])
            note["status"] = "active"
        else:
            unsure = action == "mark_candidate_uncertain"
            note = {"id": row["note_id"], "content": text, "tokens": own, "version": 1, "evidence": [], "keywords": list(row["keywords"]), "confidence": min(0.4, row["confidence"]) if unsure else row["confidence"], "status": "candidate" if unsure else "active"}
            notes.append(note)
        out[row["note_id"]] = (action, note["id"], note["version"], note["content"])
    return out, {n["id"]: (n["content"], n["version"], n["status"], round(n["confidence"], 9), sorted(n["keywords"]), n["evidence"]) for notes in memory.values() for n in notes}


def test_a_stream_with_a_restart_equals_a_plain_fold(spark, tmp_path):
    rows = conversations(spark).cache()
    want, final = plain([r.asDict() for r in rows.collect()])
    assert {w[0] for w in want.values()} == {"create_separate_memory", "mark_candidate_uncertain", "overwrite_existing", "refine_conditions", "append_detail"}
    whole = arrivals.in_order(rows)
    assert {r.new_id: (r.action, r.note_id, r.version, r.content) for r in whole.collect()} == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    for part in ("ord < 2", "ord >= 2 AND ord < 101", "ord >= 101"):  # the query is started anew for each part
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        stream = arrivals.outcomes(spark.readStream.schema(rows.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(300)
    done = spark.read.parquet(out)
    assert {r.new_id: (r.action, r.note_id, r.version, r.content) for r in done.collect()} == want
    got = {r.note_id: (r.content, r.version, r.status, round(r.confidence, 9), sorted(r.keywords), r.evidence_ids) for r in arrivals.notes_of(done).collect()}
    assert got == final
    assert sorted(map(str, arrivals.edges_of(done).collect())) == sorted(map(str, arrivals.edges_of(whole).collect()))
    assert arrivals.in_order(rows.limit(0)).count() == 0


def test_the_fold_says_when_an_index_is_due(monkeypatch):
    monkeypatch.setattr(arrivals, "THRESHOLD", 2)
    memory = arrivals.Memory()
    row = lambda i: {"note_id": str(i), "content": "tea in the garden", "tokens": ["tea", "garden"], "confidence": 0.5}
    assert [memory.add(row(i))["rebuild"] for i in range(5)] == [False, False, True, False, True]


def test_rules_of_one_note_equal_the_column_rules(spark):
    texts = ["maybe tea", "tea now instead", "I prefer tea when alone", "plain tea", "", "probably", "switched under context"]
    rows = [(a, b, o) for a in texts for b in texts for o in (0.0, 0.07, 0.1, 0.16, 0.5)]
    frame = spark.createDataFrame(rows, "content string, target string, overlap double")
    for r in frame.withColumn("d", lifecycle.decide(F.col("content"), F.col("target"), F.col("overlap"))).collect():
        assert tuple(r.d) == arrivals.decide(r.content, r.target, r.overlap)


COLS = "sample_id long, note_id string, ord long, content string, tokens array<string>, status string, version int, confidence double, memory_level string, context string, keywords array<string>, tags array<string>, domain_paths array<string>, conditions array<map<string,string>>, provided boolean"


def note(i, n, text, level="task", context="", keywords=(), conditions=(), provided=False):
    return (1, n, i, text, re.findall(r"[a-z]{3,}", text.lower()), "active", 1, 0.5, level, context, list(keywords), [], ["General"], list(conditions), provided)


def test_no_note_is_lost_and_all_arrays_are_merged(spark):
    notes = spark.createDataFrame([note(0, "a", "ann has red car lake", keywords=["car"], context="old", conditions=[{"context": "c0", "detail": "d0"}])], COLS)
    new = spark.createDataFrame(
        [
            note(2, "c", "ann has red car garage", keywords=["garage", "car"], context="new"), note(3, "d", "ann prefers red car lake when sunny", keywords=["sun", None], context=""), note(4, "n", "ann has red boat", None),
            note(5, "i", "ann has red", "INSTANCE"), note(6, "p", "ann has red lake", None, provided=True), note(7, "z", "zebra", None),
        ], COLS,
    )
    table, edges, decided = writepath.write(notes, new)
    got = {r.note_id: r for r in table.collect()}
    assert set(got) == {"a", "n", "i", "p", "z"}
    a = got["a"]
    assert a.keywords == ["car", "garage", "sun"] and a.context == "new" and a.version == 3 and a.evidence_ids == ["c", "d"]
    assert a.conditions == [{"context": "c0", "detail": "d0"}, {"context": "", "detail": "ann prefers red car lake when sunny"}]
    linked = {r.src_id for r in edges.collect()}
    assert {"n", "i"} <= linked and "p" not in linked and "z" not in linked
    assert {r.new_id: r.evolves for r in decided.collect()} == {"c": True, "d": True, "n": True, "i": True, "p": False, "z": False}
    assert writepath.evolved(decided, 97, 100) == (101, True)


def test_the_first_reason_of_an_edge_stays(spark):
    rows = [("a", "b", "same_topic", 0.2, "zeta first", "D1:1", 1), ("a", "b", "same_topic", 0.7, "alpha second", "D1:2", 2), ("a", "a", "same_topic", 0.9, "loop", None, 3), ("a", "b", "updates", 0.9, "no", None, 0)]
    frame = spark.createDataFrame(rows, "src_id string, target_id string, relation string, strength double, reason string, target_dia_id string, n int")
    for data in (frame, frame.orderBy(F.desc("n"))):
        got = graph.upsert_edges(data, "n").collect()
        assert [(r.strength, r.reason, r.target_dia_id) for r in got] == [(0.7, "zeta first", "D1:1")]


@pytest.mark.parametrize("order", [True, False])
def test_vectors_of_an_odd_length_cost_no_others_their_results(spark, order):
    from loomspark.operators import dense

    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1]), (3, [0.5, 0.5]), (4, [0.0, 1.0]), (5, []), (6, None)]
    frame = spark.createDataFrame(rows if order else rows[::-1], "note_id long, embedding array<double>").coalesce(1)
    got = {(r.query_id, r.note_id) for r in dense.nearest(frame, frame, 1).collect()}
    assert got == {(2, 3), (3, 2), (4, 3)}


def test_matching_in_rounds_equals_the_fold(spark):
    import random

    rng = random.Random(6)
    for cap, nodes, n in ((1, 12, 40), (2, 30, 200), (4, 25, 260)):
        pairs = sorted({(s, *sorted(rng.sample(range(nodes), 2))) for s in (1, 2) for _ in range(n)})
        frame = spark.createDataFrame([(s, f"n{a}", f"n{b}", a, b, 1.0) for s, a, b in pairs], "sample_id long, a_note_id string, b_note_id string, a_ord long, b_ord long, strength double")
        used, want = {}, set()
        for s, a, b in pairs:
            if used.get((s, a), 0) < cap and used.get((s, b), 0) < cap:
                used[s, a], used[s, b] = used.get((s, a), 0) + 1, used.get((s, b), 0) + 1
                want.add((s, a, b))
        assert {(r.sample_id, r.a_ord, r.b_ord) for r in graph.capped_matching(frame, cap).collect()} == want
    assert graph.capped_matching(frame.limit(0), 2).count() == 0


def test_matching_splits_one_large_sample(spark):
    """One sample of many pairs: a star, a path and a clique, spread over their notes."""
    star = [(0, k) for k in range(1, 3000)]
    path = [(10_000 + k, 10_001 + k) for k in range(0, 3000, 2)]
    clique = [(20_000 + a, 20_000 + b) for a in range(60) for b in range(a + 1, 60)]
    pairs = sorted(star + path + clique)
    frame = spark.createDataFrame([(1, str(a), str(b), a, b) for a, b in pairs], "sample_id long, a_note_id string, b_note_id string, a_ord long, b_ord long")
    used, want = {}, set()
    for a, b in pairs:
        if used.get(a, 0) < 4 and used.get(b, 0) < 4:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.add((a, b))
    assert {(r.a_ord, r.b_ord) for r in graph.capped_matching(frame, 4).collect()} == want
