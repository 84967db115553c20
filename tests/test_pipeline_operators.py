"""Scans, the write path, answers, profiles, domain trees and storage on small inputs, against plain versions."""

import math
import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import answers, dense, domains, evaluate, harness, parsers, profile, scan, writepath
from loomspark.operators import retrieval as R
from loomspark.plans import pipeline_queries
from loomspark.sources import store
from loomspark.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_scan_blocks_and_awkward_rows(spark, monkeypatch):
    notes = [(1, "Ann paints a lake", "", "Ann"), (2, "the lake is cold", "lake photo", "Bob"), (3, None, None, None), (4, "", "", ""), (5, "Ann paints a lake", "", "Ann"), (None, "lake", "", "")]
    rows = spark.createDataFrame(notes, "note_id long, main string, visual string, speaker string")
    asked = spark.createDataFrame([(k, q, q) for k, q in enumerate(["Did Ann paint the lake?", "", "cold lake", None, "zzz"])], "query_id long, query string, lexical_query string")
    depths = {"dense": 3, "bm25": 3, "lexical": 3, "entity": 3, "hybrid": 3}
    want = sorted(map(tuple, scan.rank(rows, asked, depths).collect()), key=str)
    monkeypatch.setattr(scan, "BLOCK", 2)
    monkeypatch.setattr(scan, "ROWS", 2)
    assert sorted(map(tuple, scan.rank(rows, asked, depths).collect()), key=str) == want
    entity = [(r[1], r[3]) for r in want if r[0] == 0 and r[2] == "entity"]
    # three shared tokens (ann, paint, lake), the same three inside the text, the name, the action
    assert dict(entity)[5] == dict(entity)[1] and max(s for _, s in entity) == 2 * 3 + 0.25 * 3 + 1 + 1.5
    assert not [r for r in want if r[0] in (1, 3, 4) and r[2] != "dense"]
    monkeypatch.setattr(scan, "ahocorasick", None)
    assert sorted(map(tuple, scan.rank(rows, asked, depths).collect()), key=str) == want
    assert scan.rank(rows.limit(0), asked, depths).count() == 0 and scan.rank(rows, asked.limit(0), depths).count() == 0


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    monkeypatch.setattr(dense, "ROWS", 4)
    rows = [(i, [math.cos(i), math.sin(i)], i % 2) for i in range(20)] + [(90, None, 0), (91, [1.0], 0), (92, [0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "note_id long, embedding array<double>, group long")
    got = {}
    for r in dense.nearest(frame, frame.where("note_id < 10"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.note_id))
    for q in range(10):
        score = {i: round(math.cos(i - q), 6) for i in range(20) if i != q and i % 2 == q % 2}
        if q % 2:
            score[92] = 0.0
        assert sorted(got[q]) == [(k + 1, i) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], -i))[:3])]
    assert dense.nearest(frame, frame.limit(0), 3).count() == 0


def test_containing_equals_plain(spark):
    notes = spark.createDataFrame([(1, "a lake house"), (2, "lakes"), (3, None), (4, "")], "note_id long, text string")
    asked = spark.createDataFrame([(1, "lake"), (2, "lake"), (3, "ake h"), (4, None), (5, "zz")], "query_id long, query string")
    assert sorted(map(tuple, dense.containing(notes, asked).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]


def test_graph_expansion_equals_a_plain_fold(spark):
    import random

    rng = random.Random(4)
    names = R.SIGNALS[:6]
    rows = [(1, f"n{i}", i + 1, *[rng.random() for _ in names]) for i in range(30)]
    edges = [(1, f"n{rng.randrange(30)}", f"n{rng.randrange(60)}", rng.choice([*R.RELATION_WEIGHTS, "supports"]), rng.random(), rng.random() * 3, rng.randrange(60)) for _ in range(200)]
    candidates = spark.createDataFrame(rows, "query_id long, note_id string, first_seen int, " + ", ".join(f"{n} double" for n in names))
    table = spark.createDataFrame(edges, "query_id long, src_id string, target_id string, relation string, strength double, lexical_score double, ord int")
    weights = (0.25, 0.20, 0.16, 0.12, 0.20, 0.18)
    for category in (1, 2, 4, 5):
        left_out, seeds, per_seed, most = R.EXPANSION.get(category, R.EXPANSION[0])
        want, added = {}, 0
        for _, name, _, *values in sorted(rows, key=lambda r: (-sum(w * v for w, v in zip(weights, r[3:])), r[2]))[:seeds]:
            worth = max(0.15, sum(w * v for w, v in zip(weights, values)))
            found = []
            for _, s, t, relation, strength, lexical, place in edges:
                near = category not in (2, 4) or lexical >= 1 or (category == 2 and relation in ("same_storyline", "image_text_pair"))
                if s == name and s != t and relation in R.RELATION_WEIGHTS and relation not in left_out and near:
                    found.append((worth * strength * R.RELATION_WEIGHTS[relation] * (1 + min(1, lexical / 8)), relation, place, t))
            for value, _, _, t in sorted(found, reverse=True)[: min(per_seed, most - added)]:
                want[t] = max(want.get(t, 0), value)
                added += 1
        got = {r.note_id: r.graph_expansion for r in R.expand_by_graph(candidates, table, category).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_profiles_equal_plain_rules(spark):
    text = "Ann said 'Dr Seuss' and The Four Seasons made Support Group friends in Sweden; kids love camping near lakes 2 days"
    row = spark.createDataFrame([("Ann", text, "a red necklace", None, ["lgbtq support", "weather talk"], ["misc"])], "speaker string, content string, image_caption string, image_query string, keywords array<string>, tags array<string>")
    got = profile.profiles(row).first()

    def cue(x):
        x = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9'\s-]", " ", x.lower())).strip(" -'")
        return x[:-2] if x.endswith("'s") else x

    def useful(c):
        return c in profile.PROTECTED or (len(c) >= 3 and not re.search(r"[0-9]", c) and c not in profile.GENERIC_PHRASES and not any(w in profile.GENERIC for w in c.split()))

    stem = {w: one(spark, T.canonical_token(F.col("w")), w=w) for w in re.findall(r"\b[a-z][a-z0-9']+\b", (text + " a red necklace lgbtq support weather talk misc").lower())}

    def plain(x, segments):
        found = re.findall(r"['\"]([^'\"]{2,80})['\"]", x) + re.findall(r"\b[A-Z][A-Za-z0-9']+(?:\s+(?:of|the|and|[A-Z][A-Za-z0-9']+)){0,4}", x)
        found += [s.strip() for s in re.split(r"[;,/|()\[\]\n]+", x) if 2 <= len(s.strip()) <= 80] if segments else []
        words = [t for t in (stem[w] for w in re.findall(r"\b[a-zA-Z][a-zA-Z0-9']+\b", x.lower())) if useful(t)]
        runs = [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
        return {c for c in map(cue, found) if useful(c)} | set(words) | {r for r in runs if useful(r)}

    visual = plain("a red necklace ", True)
    listed = plain("lgbtq support ; weather talk", True) | plain("misc", True)
    worthy = {c for c in listed if c in profile.PROTECTED or c in profile.STRONG or set(c.split()) & set(profile.VALUED)}
    want = plain(text, False) | worthy | {"ann"} | visual
    assert set(got.cues) == want and set(got.visual) == visual
    assert {"dr seuss", "support group", "sweden", "lgbtq support"} <= set(got.strong) and "ann" not in got.strong


def test_write_path_rules(spark):
    cols = "sample_id long, note_id string, ord long, content string, tokens array<string>, status string, version int, confidence double, memory_level string"
    row = lambda i, n, text, level="task": (1, n, i, text, re.findall(r"[a-z]{3,}", text.lower()), "active", 1, 0.5, level)
    notes = spark.createDataFrame([row(0, "a", "ann has red car lake"), row(1, "b", "bob likes tea")], cols)
    new = spark.createDataFrame([row(2, "c", "ann has red car garage"), row(3, "d", "ann now has red car lake boat"), row(4, "e", "maybe bob likes tea"), row(5, "f", "zebra"), row(6, "g", "ann has red car", "instance")], cols)
    table, edges, decided = writepath.write(notes, new)
    got = {r.note_id: r for r in table.collect()}
    assert {r.new_id: r.action for r in decided.collect()} == {"c": "append_detail", "d": "overwrite_existing", "e": "mark_candidate_uncertain", "f": "create_separate_memory", "g": "create_separate_memory"}
    assert got["a"].content == "ann now has red car lake boat" and got["a"].version == 3 and got["a"].evidence_ids == ["c", "d"]
    assert [h.version for h in got["a"].history] == [1, 2, 3] and got["a"].confidence == 0.75 and got["b"].version == 1
    assert got["e"].status == "candidate" and got["e"].confidence == 0.4 and set(got) == {"a", "b", "e", "f", "g"}
    assert ("g", "a") in {(r.src_id, r.target_id) for r in edges.collect()} and not edges.where("src_id = target_id").count()
    assert writepath.evolved(decided, 98, 100) == (101, True) and writepath.evolved(decided, 0, 100) == (3, False)
    assert writepath.write(notes.limit(0), new)[0].count() == 5 and writepath.write(notes, new.limit(0))[0].count() == 2


def test_parsers_of_odd_responses(spark):
    assert one(spark, parsers.evolution(F.col("r")), r="please UPDATE and strengthen")["decision"] == "STRENGTHEN_AND_UPDATE"
    assert one(spark, parsers.evolution(F.col("r")), r='{"should_evolve": true, "actions": ["strengthen"]}')["decision"] == "STRENGTHEN"
    assert one(spark, parsers.evolution(F.col("r")), r=None)["decision"] == "NO_EVOLUTION"
    assert one(spark, parsers.relation(F.col("r")), r="nonsense")["action"] == "create_separate_memory"
    assert one(spark, parsers.answer(F.col("r")), r='```json\n{"answer": "tea"}\n```') == "tea" and one(spark, parsers.answer(F.col("r")), r=" tea ") == "tea"
    assert one(spark, parsers.strict_fences(F.col("r")), r="a ``` b") == "a ``` b"
    assert parsers.typed_empty('{"json_schema": {"schema": {"properties": {"a": {"type": "array"}, "n": {"type": "number"}, "s": {"type": "string"}}}}}') == '{"a": [], "n": 0, "s": ""}'
    assert store.empty_or(None, "{}") == "{}"
    w = one(spark, parsers.rewrite(F.col("r")), r="CONTENT: c\nCONDITIONS:\n- context: x\n- detail: y\n- context: z\nCONFIDENCE: 7")
    assert w["conditions"] == [{"context": "x", "detail": "y"}, {"context": "z"}] and w["confidence"] == 1.0 and w["memory_level"] == "instance"


def test_answer_pipeline_with_a_fake_model(spark):
    block = "talk start time:1:56 pm on 8 May, 2023 memory content: dia_id: D1:1\nsession_date: 1:56 pm on 8 May, 2023\nspeaker: Ann\ncontent: I joined the pride parade yesterday\n"
    rows = [(1, 2, "When did Ann join the pride parade?", block, "7 May 2023", ["D1:1"]), (2, 1, "Which events has Ann attended?", block, "parade", ["D1:1", "D2:2"]), (3, 4, "Who is Bob?", "", "a man", [])]
    contexts = spark.createDataFrame(rows, "query_id long, category int, question string, context string, reference string, gold array<string>")

    def factory():
        return lambda p: "Not mentioned" if "Revise" in p else "unknown" if "temporal" in p else "parade"

    scored, totals, summary = harness.evaluate_questions(contexts, factory)
    got = {r.query_id: r.answer for r in scored.collect()}
    assert got == {1: "7 May 2023", 2: "parade", 3: "parade"}
    assert {r.metric: r["mean"] for r in totals.where("overall = 1").collect()}["exact_match"] == pytest.approx(2 / 3)
    assert {r.category: (r.hit_any, r.hit_all, r.has_gold) for r in summary.collect()} == {2: (1, 1, 1), 1: (1, 0, 1), 4: (0, 0, 0)}
    best = harness.sweep(contexts, {"m": factory, "n": lambda: lambda p: ""})
    assert {r.model: r["mean"] > 0.5 for r in best.collect()}["m"]
    assert {r.score for r in harness.judge(scored, lambda: lambda p: '{"score": 1}').collect()} == {1}
    assert harness.compress(contexts, [1], lambda: lambda p: "short").where("context = 'short'").count() == 1
    assert harness.query_keywords(contexts, lambda: lambda p: "KEYWORDS: a, b").first().retrieval_query.endswith(" ; a, b")


def test_enrichment_rewrites_and_evolution(spark):
    notes = spark.createDataFrame([("n1", "Ann saw the Lake. One day.", "Ann", "", None, None, "", "", [0], ["t"])], "note_id string, content string, speaker string, session_date string, image_caption string, image_query string, rewrite_content string, rewrite_version string, links array<int>, tags array<string>")
    asked = harness.enrich_notes(notes.select("note_id", "content"), lambda: lambda p: "pine, oak" if "five keywords" in p else "CONTEXT: trees\nTAGS: t").first()
    assert asked.keywords == ["pine", "oak"] and asked.context == "trees" and asked.tags == ["t"]
    assert harness.rewrite_notes(notes, "v1").first().rewrite_content == "Ann evidence fact: Ann saw the Lake. One day."
    said = harness.rewrite_notes(notes, "v1", lambda: lambda p: " a  line ")
    assert (said.first().rewrite_content, said.first().rewrite_version) == ("a line", "v1")
    near = spark.createDataFrame([("n1", 0, "x"), ("n1", 1, "y")], "note_id string, place int, neighbour_id string")
    reply = lambda p: "STRENGTHEN_AND_UPDATE" if "DECISION" in p else "CONNECTIONS: 3\nTAGS: u" if "CONNECTIONS" in p else "NEIGHBOR 0:\nCONTEXT: c\nTAGS: k"
    made, changes = harness.evolve(notes, near, lambda: reply, 2)
    assert made.first().links == [0, 3] and made.first().tags == ["u"]
    assert [tuple(r) for r in changes.collect()] == [("x", "c", ["k"])]


def test_domain_trees_and_annotations(spark):
    notes = spark.createDataFrame([(1, "a", "D1:1", 0, "family talk", ["family"]), (1, "b", "D1:2", 1, "zzz", ["zzz"])], "sample_id long, note_id string, dia_id string, ord long, brief string, tokens array<string>")
    tree = domains.trees(spark, notes).withColumn("tokens", T.retrieval_tokens(domains.domain_text(F.col("path"), F.col("description"), F.col("keywords"))))
    paths = {r.note_id: r.domain_paths for r in domains.annotate(notes, tree).collect()}
    assert paths["a"][0] == domains.FALLBACK[0] and paths["b"] == [domains.FALLBACK[0]]
    given = spark.createDataFrame([(1, "D1:2", ["nowhere", domains.FALLBACK[4].replace(" / ", ">")])], "sample_id long, dia_id string, paths array<string>")
    told = {r.note_id: r.domain_paths for r in domains.with_annotations(notes, given, tree).collect()}
    assert told["b"] == [domains.FALLBACK[4]] and told["a"] == paths["a"]
    own = domains.trees(spark, notes, lambda: lambda p: '{"domains": ["X > Y"]}').collect()
    assert [(r.place, r.path) for r in own] == [(0, "X / Y")]
    assert domains.trees(spark, notes, lambda: lambda p: "sorry").count() == 10
    routes = spark.createDataFrame([(1, "q", "A", 0.5, 1), (1, "q", "B", 0.4, 2)], "query_id long, query string, domain string, score double, rank int")
    assert domains.reroute(routes).first().domains == ["A", "B"]
    assert domains.reroute(routes, lambda: lambda p: "DOMAINS: b").first().domains == ["B"]


def test_graph_and_vector_storage(spark, tmp_path):
    notes = spark.createDataFrame([(1, "a", "D1:1", ["X > Y"], "seen yesterday"), (1, "b", None, ["Z"], "x")], "sample_id long, note_id string, dia_id string, domain_paths array<string>, content string")
    edges = spark.createDataFrame([(1, "a", "b", "similar_event", 0.5), (1, "b", "a", "temporal_anchor", 0.5), (1, "a", "b", "elaborates", 0.3)], "sample_id long, src_id string, target_id string, relation string, strength double")
    path = str(tmp_path / "g")
    assert store.load_graph(spark, path, notes, edges) is None
    store.save_graph(notes, edges, path)
    placed, applied = store.load_graph(spark, path, notes.withColumn("domain_paths", F.array(F.lit("old"))), edges)
    assert {r.note_id: r.domain_paths for r in placed.collect()} == {"a": ["X / Y"], "b": ["Z"]}
    assert sorted((r.src_id, r.target_id, r.relation) for r in applied.collect()) == [("a", "b", "elaborates"), ("a", "b", "similar_event")]
    vectors = spark.createDataFrame([(1, "a", [0.5])], "sample_id long, note_id string, v array<double>")
    store.save_vectors(vectors, str(tmp_path / "v"))
    assert store.load_vectors(spark, str(tmp_path / "v")).count() == 1
    logger = store.log_to(str(tmp_path / "log.txt"))
    logger.info("hello")
    assert "hello" in (tmp_path / "log.txt").read_text()


def test_late_rows_never_win_and_old_versions_go(spark, tmp_path):
    table = ingest.NotesTable(spark, str(tmp_path / "n"))
    batch = lambda *rows: spark.createDataFrame(rows, "memory_id string, arrived long, content string")
    table.merge(batch(("a", 5, "new"), ("b", 1, "b")), 0)
    table.merge(batch(("a", 3, "late"), ("b", 1, "same time")), 1)
    table.merge(batch(("c", 1, "c")), 2)
    assert {r.memory_id: r.content for r in table.read().collect()} == {"a": "new", "b": "same time", "c": "c"}
    assert table._versions() == [2, 3]


def test_bleu_and_model_metrics(spark):
    assert evaluate.bleu_scores("a b c d", "a b c d") == pytest.approx((1, 1, 1, 1)) and evaluate.bleu_scores("x", "y") == (0, 0, 0, 0) == evaluate.bleu_scores("", "y")
    got = evaluate.bleu_scores("the cat", "the cat sat")
    assert got[0] == pytest.approx(math.exp(-0.5)) and got[3] == pytest.approx(math.exp(-0.5) * math.exp(0.25 * (2 * math.log(0.1))))
    assert pipeline_queries.bleu_smoothed(spark, FOLDER).where("bleu1 < 0 OR bleu1 > 1").count() == 0
    rows = spark.createDataFrame([("a", "b", {"bert_f1": 0.0})], "prediction string, reference string, metrics map<string,double>")

    def broken(p, r):
        raise ValueError

    assert evaluate.with_model_metrics(rows, {"bert_f1": lambda p, r: [0.5] * len(p), "x": broken}).first().metrics == {"bert_f1": 0.5}


def test_edges_of_profiles_hold_their_caps(spark):
    rows = pipeline_queries.edges_from_profiles(spark, FOLDER)
    assert rows.groupBy("sample_id", "src_id").count().where("count > 8").count() == 0
    assert set(answers.CUES) == set(T.SLOT_TYPE_PATTERNS) | {"fact"}
