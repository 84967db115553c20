"""Sources, order-dependent operators, model hooks and streaming on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import bundle, enrich, evaluate, graph, lifecycle
from loomspark.operators import retrieval as R
from loomspark.plans import note_queries, retrieval_queries
from loomspark.sources import dialogue
from loomspark.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
SAMPLE = {
    "qa": [
        {"question": "When did A attend the group?", "answer": 7, "evidence": ["D1:1"], "category": 2},
        {"question": "What did B buy?", "evidence": ["D2:1", "D9:2", "none"], "category": 5, "adversarial_answer": "shoes"},
    ],
    "conversation": {
        "speaker_a": "A", "speaker_b": "B",
        "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "I went to a support group yesterday."}, {"speaker": "B", "dia_id": "D1:2", "text": "", "img_url": ["u"], "blip_caption": "a dog", "query": "dog"}],
        "session_1_date_time": "1:56 pm on 8 May, 2023", "session_2": [{"speaker": "B", "dia_id": "D2:1", "text": "I bought shoes."}], "session_2_date_time": "2:00 pm on 25 May, 2023",
        "session_3": [], "session_3_date_time": "1:00 pm on 1 June, 2023", "session_4": [{"speaker": "B", "dia_id": "D4:1", "text": "undated"}],
    },
    "event_summary": {}, "observation": {}, "session_summary": {"session_1_summary": "A and B talk."},
}


@pytest.fixture
def samples(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps([SAMPLE, SAMPLE, SAMPLE]))
    return str(path)


def test_dialogue_source(spark, samples):
    rows = dialogue.samples(spark, samples)
    assert [r.sample_id for r in rows.orderBy("sample_id").collect()] == [0, 1, 2]
    assert dialogue.samples(spark, samples, ratio=0.5).count() == 1
    turns = dialogue.turns(rows).where("sample_id = 0").orderBy("session", "pos").collect()
    assert [(t.dia_id, t.text) for t in turns] == [("D1:1", "I went to a support group yesterday."), ("D1:2", "[Image: a dog]"), ("D2:1", "I bought shoes.")]
    qa = dialogue.questions(rows).where("sample_id = 0").orderBy("qa_id").collect()
    assert [q.final_answer for q in qa] == ["7", "shoes"]
    assert dialogue.statistics(rows).first().asDict() == {"samples": 3, "questions": 6, "adversarial": 3, "sessions": 6, "turns": 9}
    loose = dialogue.image_evidence(dialogue.questions(rows), dialogue.turns(rows))
    assert {(r.sample_id, r.qa_id) for r in loose.collect()} == {(0, 1), (1, 1), (2, 1)}
    assert dialogue.image_evidence(dialogue.questions(rows), dialogue.turns(rows), exact=True).count() == 0


def test_missing_dataset_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dialogue.samples(spark, str(tmp_path / "none.json")).count()


def test_versioned_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert dialogue.read_table(spark, path) is None
    dialogue.write_table(spark.range(3), path)
    assert dialogue.read_table(spark, path).count() == 3
    monkeypatch.setattr(dialogue, "VERSION", "2")
    assert dialogue.read_table(spark, path) is None


def test_coverage_rerank_equals_a_plain_fold(spark):
    rows = retrieval_queries._with_slots(spark, FOLDER, retrieval_queries.fused(spark, FOLDER, 1))
    rows = spark.createDataFrame(rows.where("query_id < 4").collect(), rows.schema)
    got = {}
    for r in bundle.coverage_rerank(rows, 10).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.note_id)
    for query_id, order in got.items():
        pool = sorted((r for r in rows.collect() if r.query_id == query_id), key=lambda r: r["rank"])
        left, covered, sessions, want = list(pool), set(), {}, []
        for _ in range(10):
            def value(r):
                new, seen = len(set(r.slot_tokens) - covered), sessions.get(r.session, 0)
                s = r.combined + 0.025 * min(8, new) + 0.075 * min(10, r.slot_score) + 0.025 * min(1, r.lexical_score / 8) - 0.025 * seen
                s += 0.035 * (seen == 0) - 0.12 * (r.lexical_score <= 0 and r.combined < 0.2)
                return round(s, 9), new, r.combined, -r.first_seen

            best = max(left, key=value)
            left.remove(best)
            covered |= set(best.slot_tokens)
            sessions[best.session] = sessions.get(best.session, 0) + 1
            want.append(best.note_id)
        assert order == want + [r.note_id for r in left]


def test_bundles_keep_their_limits():
    ranked = [{"note_id": i, "lexical_score": 3.0} for i in range(20)]
    near = {0: [(100, 0.5), (101, 1.0), (102, 5.0)], 1: [(0, 9.0), (103, 1.0)], 2: [(104, 9.0)]}
    assert bundle.pack(ranked, near, 2, 10) == [(0, "primary"), (101, "local_context"), (1, "primary"), (103, "local_context"), *((i, "primary") for i in range(2, 6))]
    assert bundle.pack(ranked, near, 1, 3) == [(i, "primary") for i in range(10)]
    assert len(bundle.pack(ranked, {}, 4, 3)) == 3


def test_bundle_packer_query(spark):
    rows = retrieval_queries.bundle_packer(spark, FOLDER).collect()
    per = {}
    for r in rows:
        per.setdefault(r.query_id, []).append(r)
    assert per and all(len(v) <= 10 and sum(x.relation == "primary" for x in v) <= 6 for v in per.values())
    assert all(sorted(x.block_pos for x in v) == list(range(1, len(v) + 1)) for v in per.values())


def test_similar_events_equal_a_plain_fold(spark):
    pairs = graph.pair_features(note_queries._profiles(spark, FOLDER))
    got = {(r.src_id, r.target_id, r.strength) for r in graph.similar_events(pairs).collect()}
    notes = note_queries._profiles(spark, FOLDER).collect()
    want, used = set(), {}
    for a in sorted(notes, key=lambda n: (n.sample_id, n.ord)):
        for b in sorted((n for n in notes if n.sample_id == a.sample_id and n.ord > a.ord), key=lambda n: n.ord):
            over, union = len(set(a.tokens) & set(b.tokens)), len(set(a.tokens) | set(b.tokens))
            near = a.session == b.session and abs(a.turn - b.turn) <= 4 and (over >= 2 or over / max(1, union) >= 0.6)
            if near and used.get(a.note_id, 0) < 4 and used.get(b.note_id, 0) < 4:
                for n in (a, b):
                    used[n.note_id] = used.get(n.note_id, 0) + 1
                want |= {(a.note_id, b.note_id, 1.0), (b.note_id, a.note_id, 1.0)}
    assert got == want


def test_edge_targets_and_domains(spark):
    notes = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "sample_id int, note_id string, ord int")
    edges = spark.createDataFrame([(1, "b", None), (1, None, 0), (1, "zz", 9)], "sample_id int, target_id string, target_index int")
    assert sorted(str(r.target) for r in graph.resolve_targets(edges, notes).collect()) == ["None", "a", "b"]
    scored = spark.createDataFrame([(1, "x", 2, 0.1), (1, "y", 5, 0.1), (2, "x", 2, 0.9), (2, "y", 5, 0.3), (2, "z", 1, 0.2)], "query_id int, domain string, n int, score double")
    assert sorted((r.query_id, r.domain) for r in graph.route(scored).collect()) == [(1, "y"), (2, "x"), (2, "y")]


def test_backfill_and_decisions(spark):
    notes = spark.createDataFrame([("a", None)], "memory_id string, status string")
    row = lifecycle.backfill(notes).first()
    assert row.status == "active" and row.version == 1 and row.domain_paths == ["General"] and row.reliability_alpha == 1.0
    cases = [("append_detail", 9, "supports", "2.0"), ("append_detail", 3, "replaces", "x"), ("odd", 3, "none", None), ("mark_candidate_uncertain", 9, "odd", "-1")]
    df = spark.createDataFrame(cases, "a string, t int, r string, c string").withColumn("k", F.array(F.lit(3), F.lit(4)))
    out = [tuple(r.d) for r in df.select(lifecycle.normalize_decision(F.col("a"), F.col("t"), F.col("r"), F.col("c"), F.col("k")).alias("d")).collect()]
    assert out == [("append_detail", 3, "supports", 1.0), ("append_detail", 3, "semantic_related", 0.6), ("create_separate_memory", 3, "none", 0.6), ("mark_candidate_uncertain", 9, "semantic_related", 0.0)]
    none = df.limit(1).select(lifecycle.normalize_decision(F.col("a"), F.col("t"), F.col("r"), F.col("c"), F.array().cast("array<int>")).alias("d")).first().d
    assert none.action == "create_separate_memory"


def test_model_hooks(spark):
    enrich.register_backend("echo", lambda prefix="": lambda p: prefix + p)
    assert enrich.make_client("ECHO", prefix=">")("x") == ">x"
    with pytest.raises(ValueError):
        enrich.make_client("nothing")
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError
        return "READY"

    assert enrich.with_retries(flaky, delay=0.0)("p") == "READY" and len(calls) == 3
    assert enrich.check(lambda p: "READY") and not enrich.check(lambda p: "")

    def factory():
        def client(prompt):
            if prompt == "bad":
                raise RuntimeError
            return prompt.upper()

        return client

    rows = spark.createDataFrame([("a",), ("bad",)], "prompt string")
    assert {r.prompt: r.response for r in enrich.complete(rows, factory).collect()} == {"a": "A", "bad": None}


def test_relation_and_domain_parsers(spark):
    rows = spark.createDataFrame(
        [("ACTION: append_detail\nTARGET: index 2\nRELATION: Supports\nCONFIDENCE: 1.7\nREASON: why",), ('```json\n{"action": "overwrite_existing", "target": 1, "relation": "same_topic", "confidence": 0.3}\n```',), ("nothing",)], "r string"
    )
    out = [tuple(x.p) for x in rows.select(enrich.parse_relation(F.col("r")).alias("p")).collect()]
    assert out == [("append_detail", 2, "supports", 1.0, "why"), ("overwrite_existing", 1, "same_topic", 0.3, ""), (None, None, None, 0.6, "")]
    valid = F.array(F.lit("A / B"), F.lit("C"))
    said = spark.createDataFrame([('{"domains": ["C", "x", "A>B"]}',), ("DOMAINS: C\nREASON: r",), ("",)], "r string")
    assert [x.d for x in said.select(enrich.parse_domains(F.col("r"), valid).alias("d")).collect()] == [["C", "A / B"], ["C"], ["A / B", "C"]]


def test_metrics_of_empty_and_equal_answers(spark):
    rows = spark.createDataFrame([("7 May, 2023", "7 may 2023"), ("", "x"), (None, None), ("a b", "b c")], "p string, r string")
    maps = [x.m for x in rows.select(evaluate.metrics(F.col("p"), F.col("r")).alias("m")).collect()]
    assert maps[0]["f1"] == 1.0 and maps[0]["exact_match"] == 0.0 and len(maps[0]) == 14
    assert len(maps[1]) == len(maps[2]) == 12 and set(maps[1].values()) == {0.0}
    assert maps[3]["f1"] == 0.5 and maps[3]["bleu1"] == 0.5


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(R.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]


def test_turn_ids_and_queries(spark):
    rows = spark.createDataFrame([("D1:12", "D3:4 and D3:4, D10:2"), ("x", None)], "d string, t string")
    out = rows.select(T.dia_session(F.col("d")), T.dia_turn(F.col("d")), T.dia_ids(F.col("t"))).collect()
    assert tuple(out[0]) == (1, 12, ["D3:4", "D10:2"]) and tuple(out[1]) == (None, None, [])
    q = spark.createDataFrame([("q", "k"), ("q", "Q"), ("q", "")], "a string, b string").select(T.retrieval_query(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in q] == ["q ; k", "q", "q"]


def test_stream_merges_into_the_notes_table(spark, tmp_path):
    source, schema = tmp_path / "in", "memory_id string, arrived long, content string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.parquet(str(source))
    notes = ingest.NotesTable(spark, str(tmp_path / "table"))
    assert notes.read() is None
    stream = lambda: ingest.start(spark.readStream.schema(schema).parquet(str(source)), notes, str(tmp_path / "check")).awaitTermination()
    stream()
    spark.createDataFrame([("a", 2, "changed"), ("a", 3, "newest"), ("c", 2, "z")], schema).write.mode("append").parquet(str(source))
    stream()
    assert {r.memory_id: r.content for r in notes.read().collect()} == {"a": "newest", "b": "y", "c": "z"}


def test_windowed_counts(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert ingest.counts_by_window(events).agg(F.sum("n")).first()[0] == events.count()
