import json
import os

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import calls, domains, enrich, harness, numbering, scan
from loomspark.sources import dialogue, scratch, store


class Counting:
    """A model whose calls are counted in files, since they happen in other processes; every answer differs from the last."""

    def __init__(self, folder, answer=None):
        self.folder, self.answer = str(folder), answer

    def __call__(self):
        import uuid

        def client(prompt):
            name = uuid.uuid4().hex
            with open(os.path.join(self.folder, name), "w") as f:
                f.write(prompt)
            return self.answer(prompt) if self.answer else name

        return client

    def prompts(self):
        return sorted(open(os.path.join(self.folder, n)).read() for n in os.listdir(self.folder))


@pytest.fixture
def model(tmp_path):
    (tmp_path / "calls").mkdir()
    return Counting(tmp_path / "calls")


BLOCK = "talk start time:1:56 pm on 8 May, 2023 memory content: dia_id: D1:1\nsession_date: 1:56 pm on 8 May, 2023\nspeaker: Ann\ncontent: I joined the pride parade yesterday\n"


def contexts(spark, n=4):
    rows = [(i, 1 + i % 4, f"Which events has Ann attended, {i}?", BLOCK, "parade", ["D1:1"]) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, category int, question string, context string, reference string, gold array<string>")


def test_one_call_a_prompt_whatever_reads_the_result(spark, model):
    rows = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)] + [(99, None)], "id long, prompt string").repartition(5)
    done = calls.complete(rows, model)
    first = {r.id: r.response for r in done.collect()}
    again = {r.id: r.response for r in done.union(done).collect()}
    assert model.prompts() == ["p0", "p1", "p2"] and first == again and first[99] is None
    assert len({first[i] for i in range(30)}) == 3


def test_answers_evolution_and_evaluation_call_once_a_prompt(spark, model):
    scored, totals, summary = harness.evaluate_questions(contexts(spark), model)
    for _ in range(2):
        assert scored.count() == 4 and totals.count() and summary.count()
    assert len(model.prompts()) == len(set(model.prompts())) == 5  # four answers, one revision for category 1
    notes = spark.createDataFrame([(f"n{i}", f"text {i}", [0], ["t"]) for i in range(3)], "note_id string, content string, links array<int>, tags array<string>")
    near = spark.createDataFrame([("n1", 0, "x")], "note_id string, place int, neighbour_id string")
    before = len(model.prompts())
    model.answer = lambda p: "STRENGTHEN_AND_UPDATE" if "DECISION" in p else "CONNECTIONS: 3\nTAGS: u" if "CONNECTIONS" in p else "NEIGHBOR 0:\nCONTEXT: c\nTAGS: k"
    made, changes = harness.evolve(notes, near, model, 2)
    assert made.count() == 3 and changes.count() == 1 and made.count() == 3
    assert len(model.prompts()) == before + 9 and len(set(model.prompts())) == before + 9


def test_a_table_of_calls_outlives_failures_and_runs(spark, model, tmp_path):
    table = calls.CallTable(spark, str(tmp_path / "table"), "m1", wave=4)
    rows = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "id long, prompt string")

    def broken(prompt):
        if prompt in ("q3", "q5"):
            raise TimeoutError("slow")
        return prompt.upper()

    model.answer = broken
    kept = calls.Model(model, table)
    got = {r.id: r.response for r in enrich.complete(rows, kept).collect()}
    assert got[3] is None and got[4] == "Q4" and len(model.prompts()) == 20
    assert {r.error: r.n for r in table.failures().collect()} == {"TimeoutError": 2}
    model.answer = str.upper
    got = {r.id: r.response for r in enrich.complete(rows, calls.Model(model, calls.CallTable(spark, str(tmp_path / "table"), "m1"))).collect()}
    assert got[3] == "Q3" and len(model.prompts()) == 22  # the two that failed, no others
    other = calls.Model(model, calls.CallTable(spark, str(tmp_path / "table"), "m2"))
    assert enrich.complete(rows.limit(2), other).count() == 2 and len(model.prompts()) == 24  # another model is asked itself
    assert enrich.complete(rows.limit(0), kept).count() == 0


def test_a_sweep_that_broke_off_repeats_no_finished_run(spark, model, tmp_path):
    path = str(tmp_path / "runs")
    ran = []

    def given(k):
        ran.append(k)
        return contexts(spark, 2).withColumn("context", F.concat("context", F.lit(f"content: {k}")))

    def dead():
        raise RuntimeError("no such model")

    good = Counting(tmp_path / "calls")
    good.answer = lambda p: "parade"
    other = calls.Model(dead, None)
    with pytest.raises(AttributeError):  # a model without a table fails as a whole
        harness.sweep_runs(given, {"a": good, "7": other}, [1, 2], path, side_by_side=2)
    n = len(good.prompts())
    assert n == 6 and scratch.exists(spark, f"{path}/model=a/k=2/_SUCCESS") and not scratch.exists(spark, f"{path}/model=7/k=1/_SUCCESS")
    done = harness.sweep_runs(given, {"a": good, "7": lambda: lambda p: "lake"}, [1, 2], path, side_by_side=2)
    assert len(good.prompts()) == n
    means = {(r.model, r.k): r["mean"] for r in done.where("metric = 'f1'").collect()}
    assert set(means) == {("a", 1), ("a", 2), ("7", 1), ("7", 2)} and means["a", 1] > means["7", 1]


def test_only_stale_partitions_change(spark, tmp_path):
    path = str(tmp_path / "stage")
    keys = spark.range(10).select(F.col("id").alias("sample_id"))
    built = []

    def build(due):
        built.append(sorted(r.sample_id for r in due.collect()))
        return due.select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("x"))

    files = lambda: {(d, f): os.stat(os.path.join(path, d, f)).st_mtime_ns for d in os.listdir(path) if d.startswith("sample_id") for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")}
    assert dialogue.load_or_build(spark, path, keys, "sample_id", build).count() == 30
    dialogue.write_partitions(spark.createDataFrame([(3, 9), (8, 9)], "sample_id long, x int"), path, "sample_id", version="0")
    before = files()
    again = dialogue.load_or_build(spark, path, keys, "sample_id", build)
    after = files()
    assert again.count() == 30 and again.where("x = 9").count() == 0 and again.schema["sample_id"].dataType == keys.schema["sample_id"].dataType
    assert built == [list(range(10)), [3, 8]]
    assert {d for d, _ in before.items() ^ after.items() for d in [d[0]]} == {"sample_id=3", "sample_id=8"}
    assert dialogue.load_or_build(spark, path, keys.limit(4), "sample_id", build).count() == 12 and len(built) == 2


def test_the_graph_of_a_sample_is_loaded_or_built(spark, tmp_path):
    cols = "sample_id long, note_id string, dia_id string, domain_paths array<string>, content string"
    notes = spark.createDataFrame([(s, f"{s}{n}", f"D{s}:{i}", ["General"], "seen yesterday") for s in (1, 2, 3) for i, n in enumerate("ab")], cols)
    edges = spark.createDataFrame([(1, "1a", "1b", "same_topic", 0.5)], "sample_id long, src_id string, target_id string, relation string, strength double")
    asked = []

    def build(some):
        asked.append(sorted({r.sample_id for r in some.collect()}))
        made = some.groupBy("sample_id").agg(F.min("note_id").alias("src_id"), F.max("note_id").alias("target_id")).where("sample_id < 3")
        return some.withColumn("domain_paths", F.array(F.lit("A / B"))), made.select("sample_id", "src_id", "target_id", F.lit("same_character").alias("relation"), F.lit(0.4).alias("strength"))

    for some in (notes.where("sample_id < 3"), notes):
        placed, linked = store.prepare_graph(spark, str(tmp_path / "g"), some, edges, build)
        assert {tuple(r.domain_paths) for r in placed.collect()} == {("A / B",)}
        assert {(r.src_id, r.relation) for r in linked.collect()} == {("1a", "same_topic"), ("1a", "same_character"), ("2a", "same_character")}
    assert asked == [[1, 2], [3]]


def test_result_files_of_a_folder(spark, tmp_path):
    for name, f1 in (("m_k10", 0.2), ("deep/m_k20", 0.6), ("n_k10_extra", 0.4)):
        target = tmp_path / f"{name}.json"
        target.parent.mkdir(exist_ok=True)
        target.write_text(json.dumps({"f1": f1, "other": {"a": 1}}, indent=1))
    (tmp_path / "notes.txt").write_text("no result")
    best = {r.model: (r.best_k, r.best_f1) for r in dialogue.best_k(dialogue.results(spark, str(tmp_path))).collect()}
    assert best == {"m": (20, 0.6), "n": (10, 0.4)}


def test_the_number_of_jobs_does_not_grow_with_the_questions(spark, monkeypatch):
    notes = spark.createDataFrame([(i, f"note {i} of tea and lake{i % 7}", "cat", "ann") for i in range(40)], "note_id long, main string, visual string, speaker string").cache()
    asked = spark.createDataFrame([(q, f"Where is lake{q % 7} tea?", f"Where is lake{q % 7} tea?") for q in range(40)], "query_id long, query string, lexical_query string").cache()
    notes.count(), asked.count()

    def jobs(block):
        monkeypatch.setattr(scan, "BLOCK", block)
        spark.sparkContext.setJobGroup(f"scan-{block}", "")
        found = scan.rank(notes, asked, {"dense": 5, "bm25": 5, "lexical": 5, "entity": 5, "hybrid": 5}).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scan-{block}")), sorted(map(tuple, found), key=str)

    one, ten = jobs(40), jobs(4)
    assert one == ten


def test_numbers_inside_groups_of_any_size(spark):
    rows = [("big", i) for i in range(5000)] + [("small", 3), (None, 1), (None, 2)]
    got = numbering.numbered(spark.createDataFrame(rows, "g string, o long").repartition(7), "g", ["o"], "at").collect()
    assert sorted((r.o, r["at"], r.at_of) for r in got if r.g == "big") == [(i, i, 5000) for i in range(5000)]
    assert [(r["at"], r.at_of) for r in got if r.g == "small"] == [(0, 1)] and sorted((r.o, r["at"], r.at_of) for r in got if r.g is None) == [(1, 0, 2), (2, 1, 2)]


def test_annotation_answers_of_every_shape(spark):
    tree = spark.createDataFrame([(1, 0, "A / B", "d"), (1, 1, "C", ""), (1, 2, "E", ""), (1, 3, "F", "")], "sample_id long, place int, path string, description string")
    notes = spark.createDataFrame([(1, f"n{i}", i, f"D1:{i}" if i != 9 else None, f"talk {i}", ["family"]) for i in range(17)], "sample_id long, note_id string, ord long, dia_id string, brief string, tokens array<string>")
    prompts = domains.annotation_prompts(notes, tree).orderBy("batch").collect()
    assert [r.prompt.count("\n- D1:") for r in prompts] == [8, 7, 1] and all("- A / B: d\n- C: " in r.prompt for r in prompts)
    said = [
        (1, 0, 'So: {"annotations": [{"dia_id": "D1:0", "domain_paths": ["A>B", "C", "E", "F"]}, {"dia_id": "D1:1", "domains": "C"}, {"dia_id": "", "domain_paths": ["C"]}, {"dia_id": "D1:2", "domain_paths": ["X"]}, {"dia_id": "D1:3", "domain_paths": ["C", "C"]}]}'),
        (1, 1, '```json\n{"memories": [{"dia_id": "D1:3", "domain_paths": "F"}, {"dia_id": "D1:4", "domain_paths": [], "domains": ["E"]}]}\n```'), (1, 2, "nonsense"), (1, 3, None),
    ]
    got = domains.said_annotations(spark.createDataFrame(said, "sample_id long, batch long, response string"), tree).collect()
    assert {r.dia_id: r.paths for r in got} == {"D1:0": ["A / B", "C", "E"], "D1:1": ["C"], "D1:3": ["F"], "D1:4": ["E"]}
    full = tree.withColumn("tokens", T.retrieval_tokens(F.col("path")))
    done = domains.annotate_with_model(notes, full, lambda: lambda p: '{"annotations": [{"dia_id": "D1:0", "domain_paths": ["C"]}]}')
    assert {r.note_id: r.domain_paths for r in done.collect()} == {"n0": ["C"], **{f"n{i}": ["A / B"] for i in range(1, 17)}}


def test_trees_of_any_shape(spark):
    responses = [
        '{"domains": ["A > B", {"name": "C", "tags": "x; y/ z"}, 7, null, ["q"], {"path": "", "domain_path": "D", "summary": "s", "keywords": [" k ", 5, ""]}, "A/B", {"description": "no path"}]}',
        'text {"domain_tree": {"domains": [{"title": "E", "keywords": null, "tags": ["t"]}]}} text', '{"domains": {}, "tree": ["F"]}', '{"domains": "G"}', "no json", None, '{"domains": [' + ", ".join(f'"P{i}"' for i in range(50)) + "]}",
    ]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "i int, response string")
    got = {r.i: [(e.path, e.description, e.keywords) for e in r.tree] for r in frame.select("i", domains.parse_tree(F.col("response")).alias("tree")).collect()}
    assert got[0] == [("A / B", "", []), ("C", "", ["x", "y", "z"]), ("D", "s", ["k", "5"]), (T.DEFAULT_DOMAIN, "no path", [])]
    assert got[1] == [("E", "", ["t"])] and got[2] == [("F", "", [])] and got[3] == got[4] == got[5] == []
    assert [p for p, _, _ in got[6]] == [f"P{i}" for i in range(36)]


def test_an_encoder_of_any_dimension_in_any_batch_size(spark):
    from loomspark.operators import encode

    rows = spark.createDataFrame([(i, f"tea lake w{i}") for i in range(50)] + [(98, ""), (99, None)], "id int, text string").repartition(3)
    seen = [{r.id: tuple(r.embedding) for r in encode.encode(rows, F.col("text"), encode.hashed(dim), batch=size).collect()} for dim, size in ((384, 1), (384, 7), (384, 1000), (5, 64))]
    assert seen[0] == seen[1] == seen[2] and {len(v) for v in seen[0].values()} == {384} and {len(v) for v in seen[3].values()} == {5}
    assert not any(seen[0][99]) and sum(x * x for x in seen[0][3]) == pytest.approx(1)
