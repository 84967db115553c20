"""Runs over whole question sets: model steps around retrieval, link expansion, judging, evaluation and sweeps.

Every model call goes through enrich.complete; a call that fails gives null, and each step says what then holds.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import answers, enrich, evaluate, parsers
from loomspark.sources import scratch

Factory = Callable[[], enrich.Client]
# The order in which relations are expanded, and how it differs for category 1.
PRIORITY = {"similar_event": 0, "same_storyline": 1, "image_text_pair": 2, "same_character": 3, "local_context": 4, "same_entity": 6, "same_topic": 7, "semantic_related": 8}
PRIORITY_FIRST = PRIORITY | {"same_storyline": 0, "image_text_pair": 1, "similar_event": 2, "same_character": 5}


def expansion_order(edges: DataFrame, category: int) -> DataFrame:
    """edges with place: of each source (and query, where there is one) by the relation's priority, then the stronger first."""
    order = PRIORITY_FIRST if category == 1 else PRIORITY
    priority = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("relation")), F.lit(99))
    keys = [c for c in ("query_id", "sample_id", "src_id") if c in edges.columns]
    return edges.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(priority, F.desc("strength"), "target_id")))


def follow_links(primaries: DataFrame, notes: DataFrame, k: int) -> DataFrame:
    """query_id, place, link, note_id: each primary (link 0) and the notes its links name by list place, k + 1 at most; repeats stay.

    primaries: query_id, place, note_id; notes: note_id, ord, links (array of places).
    """
    own = primaries.join(notes.select("note_id", "links"), "note_id")
    linked = own.select("query_id", "place", F.posexplode("links").alias("i", "ord")).where(F.col("i") <= k)
    named = linked.join(notes.select("ord", "note_id"), "ord").select("query_id", "place", (F.col("i") + 1).alias("link"), "note_id")
    return primaries.select("query_id", "place", F.lit(0).alias("link"), "note_id").unionByName(named)


def query_keywords(questions: DataFrame, factory: Factory | None = None) -> DataFrame:
    """questions with retrieval_query: the question and a model's keywords, or the question alone."""
    if factory is None:
        return questions.withColumn("retrieval_query", F.col("question"))
    asked = questions.withColumn("prompt", F.concat(F.lit("Name the keywords to search for, comma-separated.\nQuestion: "), "question"))
    said = enrich.complete(asked, factory)
    return said.withColumn("retrieval_query", T.retrieval_query(F.col("question"), parsers.keyword_line(F.col("response")))).drop("prompt", "response")


def compress(contexts: DataFrame, categories: list[int], factory: Factory) -> DataFrame:
    """contexts (query_id, category, question, context, ...) cut down to what a model calls relevant, for some categories; else as they are."""
    some = F.col("category").isin(categories)
    asked = contexts.where(some).withColumn("prompt", F.concat(F.lit("Give the parts of the memories that matter for the question.\nQuestion: "), "question", F.lit("\nMemories:\n"), "context"))
    said = parsers.relevant_parts(F.col("response"))
    cut = enrich.complete(asked, factory).withColumn("context", F.when(F.col("response").isNotNull() & (said != ""), said).otherwise(F.col("context")))
    return cut.select(*contexts.columns).unionByName(contexts.where(~some))


def enrich_notes(notes: DataFrame, factory: Factory) -> DataFrame:
    """notes (content) with keywords, context and tags: a model's, asked once more for keywords it left out, then the rules' for what is missing."""
    said = enrich.complete(notes.withColumn("prompt", F.concat(F.lit("Answer with KEYWORDS:, CONTEXT: and TAGS: for this memory.\n"), "content")), factory, out="_first")
    bare = F.regexp_extract(F.coalesce("_first", F.lit("")), r"(?is)KEYWORDS\s*:\s*(\S)|\"keywords\"\s*:\s*\[\s*(\")", 0) == ""
    again = enrich.complete(said.where(bare).withColumn("prompt", F.concat(F.lit("List five keywords of this memory, comma-separated.\n"), "content")), factory, out="_second")
    both = said.where(~bare).withColumn("_second", F.lit(None).cast("string")).unionByName(again)
    told = F.concat_ws("\n", F.when(F.coalesce("_second", F.lit("")) != "", F.concat(F.lit("KEYWORDS: "), "_second")), F.coalesce("_first", F.lit("")))
    analysed = both.withColumn("_a", enrich.parse_analysis(F.when(bare, told).otherwise(F.col("_first")), F.col("content")))
    return analysed.select(*notes.columns, "_a.keywords", "_a.context", "_a.tags")


def rewrite_notes(notes: DataFrame, version: str, factory: Factory | None = None) -> DataFrame:
    """notes with rewrite_content and rewrite_version; one of this version already is kept, a model is asked for the others, the rule serves where it fails.

    notes: speaker, session_date, content, image_caption, image_query, rewrite_content, rewrite_version.
    """
    kept = (F.col("rewrite_version") == version) & (F.coalesce("rewrite_content", F.lit("")) != "")
    rule = T.rewrite_text(*[F.coalesce(c, F.lit("")) for c in ("speaker", "session_date", "content", "image_caption", "image_query")])
    rest = notes.where(~F.coalesce(kept, F.lit(False)))
    if factory is None:
        made = rest.withColumn("rewrite_content", rule)
    else:
        asked = enrich.complete(rest.withColumn("prompt", F.concat(F.lit("State the evidence in this memory in one line.\n"), F.coalesce("content", F.lit("")))), factory)
        said = T.squeeze(F.col("response"))
        made = asked.withColumn("rewrite_content", F.when(said != "", said).otherwise(rule)).select(*notes.columns)
    return notes.where(kept).unionByName(made.withColumn("rewrite_version", F.lit(version)))


def evolve(notes: DataFrame, near: DataFrame, factory: Factory, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The older evolution of new notes: notes with links and tags strengthened, and changes (note_id, context, tags) of their neighbours.

    notes: note_id, content, links (array of places), tags; near: note_id, place (from 0), neighbour_id. Up to three
    calls a note: whether to evolve, how to strengthen, what the neighbours become.
    """
    said = enrich.complete(notes.withColumn("prompt", F.concat(F.lit("Answer with DECISION: and REASON:. Should this memory evolve?\n"), "content")), factory, out="_d")
    decided = said.withColumn("_d", parsers.evolution(F.col("_d"))["decision"])
    strong, update = F.col("_d").isin("STRENGTHEN", "STRENGTHEN_AND_UPDATE"), F.col("_d").isin("UPDATE_NEIGHBOR", "STRENGTHEN_AND_UPDATE")
    more = enrich.complete(decided.where(strong).select("note_id", F.concat(F.lit("Answer with CONNECTIONS: and TAGS: for this memory.\n"), "content").alias("prompt")), factory, out="_s")
    more = more.select("note_id", parsers.strengthen(F.col("_s")).alias("_s"))
    joined = notes.join(more, "note_id", "left")
    tags = F.when(F.size("_s.tags") > 0, F.col("_s.tags")).otherwise(F.col("tags"))
    links = F.when(F.col("_s").isNotNull(), F.concat("links", "_s.connections")).otherwise(F.col("links"))
    strengthened = joined.withColumns({"links": links, "tags": tags}).select(*notes.columns)
    told = enrich.complete(decided.where(update).select("note_id", F.concat(F.lit("Answer with NEIGHBOR i: blocks of CONTEXT: and TAGS:.\n"), "content").alias("prompt")), factory, out="_u")
    blocks = told.select("note_id", F.posexplode(parsers.neighbours(F.col("_u"), n)).alias("place", "b"))
    changes = blocks.join(near, ["note_id", "place"]).where((F.col("b.context") != "") | (F.size("b.tags") > 0))
    return strengthened, changes.select(F.col("neighbour_id").alias("note_id"), "b.context", "b.tags")


def judge(rows: DataFrame, factory: Factory) -> DataFrame:
    """rows (question, prediction, reference) with score, 1 or 0, by a model judge; no response scores 0."""
    asked = rows.withColumn("prompt", F.concat(F.lit('Is the answer right? Reply {"score": 0 or 1}.\nQuestion: '), "question", F.lit("\nReference: "), "reference", F.lit("\nAnswer: "), "prediction"))
    return enrich.complete(asked, factory).withColumn("score", evaluate.judge_score(F.col("response"))).drop("prompt", "response")


def diagnose(contexts: DataFrame) -> DataFrame:
    """query_id, category, has_gold, retrieved, hit_any, hit_all and missed of each context. contexts: query_id, category, context, gold (turn ids)."""
    seen = T.dia_ids(F.col("context"))
    rows = contexts.select("query_id", "category", (F.size("gold") > 0).alias("has_gold"), seen.alias("retrieved"), evaluate.evidence(F.col("gold"), seen).alias("e"))
    return rows.select("query_id", "category", "has_gold", "retrieved", "e.hit_any", "e.hit_all", "e.missed")


def evaluate_questions(contexts: DataFrame, factory: Factory, categories: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers with metrics, the metrics' aggregates, and the evidence summary of a question set.

    contexts: query_id, category, question, context, reference, gold.
    """
    rows = contexts if categories is None else evaluate.of_categories(contexts, categories)
    given = answers.answer_questions(rows.select("query_id", "category", "question", "context"), factory)
    both = given.join(rows.select("query_id", "question", "reference"), "query_id")
    scored = both.withColumn("prediction", F.coalesce("answer", F.lit(""))).withColumn("metrics", evaluate.metrics(F.col("prediction"), F.coalesce("reference", F.lit(""))))
    return scored, evaluate.aggregate_metrics(scored.select(F.col("category").cast("string").alias("category"), "metrics")), evaluate.diagnostics(diagnose(rows))


def sweep(contexts: DataFrame, models: dict[str, Factory], metric: str = "f1") -> DataFrame:
    """model, metric, mean over all questions, for each of several models."""
    parts = []
    for name, factory in models.items():
        _, totals, _ = evaluate_questions(contexts, factory)
        parts.append(totals.where((F.col("overall") == 1) & (F.col("metric") == metric)).select(F.lit(name).alias("model"), "metric", "mean"))
    return reduce(DataFrame.unionByName, parts)


def sweep_runs(contexts: Callable[[int], DataFrame], models: dict[str, Factory], ks: list[int], path: str, side_by_side: int = 4) -> DataFrame:
    """model, k, metric, mean and n of every run of each model with each k: runs go side by side, each is a partition of path, and finished ones are not repeated.

    contexts gives the questions with their contexts for a k. The jobs of a run share a scheduler pool (``spark.scheduler.mode=FAIR`` divides
    the executors among them). A model that fails stops none of the others; the failure is raised when all are done, and
    what was finished is there for the next call. With ``enrich.Model`` not even the responses of a broken run are asked for again.
    """
    spark = contexts(ks[0]).sparkSession
    due = [(m, k) for m in models for k in ks if not scratch.exists(spark, f"{path}/model={m}/k={k}/_SUCCESS")]

    def one(run: tuple[str, int]) -> None:
        name, k = run
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{k}")
        _, totals, _ = evaluate_questions(contexts(k), models[name])
        totals.where("overall = 1").select("metric", "mean", F.col("count").alias("n")).write.mode("overwrite").parquet(f"{path}/model={name}/k={k}")

    with ThreadPoolExecutor(max_workers=max(1, side_by_side)) as pool:
        outcomes = [pool.submit(inheritable_thread_target(spark)(one), run) for run in due]
    failures = [f.exception() for f in outcomes if f.exception() is not None]
    if failures:
        raise failures[0]
    # partition columns as text, since a model's name may look like a number
    return spark.read.option("basePath", path).schema("metric string, mean double, n long, model string, k int").parquet(path)


def retrieve_context(bundle: DataFrame, notes: DataFrame) -> DataFrame:
    """query_id and context of packed bundles: retrieval without answering. bundle: query_id, block_pos, note_id, relation; notes: note_id, date, content."""
    return answers.context_of(bundle.join(notes.select("note_id", "date", "content"), "note_id"))
