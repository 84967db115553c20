"""Retrieval: indexes, rankings and fusion over documents, vectors and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import bundle, dense, encode, graph, lifecycle, scan
from loomspark.operators import retrieval as R
from loomspark.plans import duck
from loomspark.plans.registry import query, table
from loomspark.sources import postings, scratch

DIM = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text", "source", "lang", T.retrieval_tokens(F.col("text")).alias("tokens"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.retrieval_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {duck.BM25} {duck.top('bm25', 10)}")
def bm25_topk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the ten best documents of each question."""
    return R.top_k(R.bm25(documents(spark, sf_dir), questions(spark, sf_dir)), 10).select("query_id", "note_id", "score", "rank")


@query(f"WITH {duck.BM25} SELECT token, df, n_docs, round(avgdl, 6) AS avgdl, round(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    idf = F.round(F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6)
    return R.document_frequency(docs).crossJoin(F.broadcast(R.index_stats(docs))).select("token", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"), idf.alias("idf"))  # one row


def _postings(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """An index built in two halves, at a place of its own."""
    path = scratch.fresh(spark, "index")
    index = postings.Postings(spark, path, "index_" + path.rsplit("-", 1)[1], chunk=F.floor(F.col("note_id") / 256))
    docs = scratch.materialise(documents(spark, sf_dir).select("note_id", "tokens"), "index-notes")
    index.append(docs.where("note_id % 2 = 0"))
    index.append(docs.where("note_id % 2 = 1"))
    scratch.discard(docs)
    return index


@query(f"WITH {duck.BM25} {duck.top('bm25', 10)}")
def bm25_topk_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over a persisted index that was appended to: postings lie bucketed by token and are not shuffled."""
    index = _postings(spark, sf_dir)
    return R.top_k(index.bm25(questions(spark, sf_dir)), 10).select("query_id", "note_id", "score", "rank")


@query(f"WITH {duck.BM25} {duck.top('bm25', 10)}")
def bm25_topk_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the chunks left out whose bounds say that none of their notes can be among the ten best."""
    return _postings(spark, sf_dir).top_k(questions(spark, sf_dir), 10)[0].select("query_id", "note_id", "score", "rank")


_DENSE = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS note_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id {0}) """


@query(_DENSE.format("") + duck.top("s", 5))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of each query vector; the queries are every twentieth row, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding")
    return dense.nearest(rows, rows.where("note_id % 20 = 0"), 5)


@query(_DENSE.format("AND q.label = e.label") + duck.top("s", 5))
def dense_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the rows of the query's label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding", F.col("label").alias("group"))
    return dense.nearest(rows, rows.where("note_id % 20 = 0"), 5)


_HASH = f"list_transform(range({DIM}), lambda i: CAST(len([t FOR t IN tokens IF CAST('0x' || left(md5(t), 8) AS BIGINT) % {DIM} = i]) AS DOUBLE))"


@query(
    f"WITH {duck.BM25}, h AS (SELECT note_id, {_HASH} AS v FROM d), u AS (SELECT note_id, unnest(range({DIM})) AS place, unnest(v) AS x, sqrt(list_dot_product(v, v)) AS norm FROM h) "
    "SELECT note_id, CAST(place AS INT) AS place, round(x / norm, 6) AS value FROM u WHERE x > 0"
)
def hashed_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed bag-of-tokens vector of each document, as its places that are not 0."""
    rows = documents(spark, sf_dir).select("note_id", F.explode("tokens").alias("t"))
    place = (F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long") % DIM).cast("int")
    counts = rows.groupBy("note_id", place.alias("place")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("note_id")))
    return counts.select("note_id", "place", F.round(F.col("x") / norm, 6).alias("value"))


_HASH_WIDE = _HASH.replace(str(DIM), str(encode.DIM))


@query(
    f"WITH {duck.BM25}, h AS (SELECT note_id, {_HASH_WIDE} AS v FROM d), u AS (SELECT note_id, unnest(range({encode.DIM})) AS place, unnest(v) AS x, sqrt(list_dot_product(v, v)) AS norm FROM h) "
    "SELECT note_id, CAST(place AS INT) AS place, round(x / norm, 6) AS value FROM u WHERE x > 0"
)
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a batch encoder that is loaded once a worker (the hashed one of 384 places), as the places that are not 0."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), encode.tokens_as_text(F.col("text")).alias("words"))
    made = encode.encode(docs, F.col("words"), encode.hashed()).select("note_id", F.posexplode("embedding").alias("place", "x"))
    return made.where("x > 0").select("note_id", "place", F.round("x", 6).alias("value"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: the source is speaker and visual text, lang the session; status and counts follow a rule on doc_id (duck.LIFECYCLE)."""
    status = F.when(F.col("doc_id") % 10 == 7, "stale").when(F.col("doc_id") % 10 == 8, "candidate").when(F.col("doc_id") % 10 == 9, "deprecated").otherwise("active")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("note_id"), F.col("text").alias("main"), F.col("source").alias("visual"), F.col("source").alias("speaker"), F.col("lang").alias("session"),
        F.concat_ws(" / ", "source", "lang").alias("path"), status.alias("status"), (F.col("doc_id") % 5).alias("success"), (F.col("doc_id") % 3).alias("failed"), (F.col("doc_id") % 7).alias("citations"),
    )


def asked(spark: SparkSession, sf_dir: str, category: int) -> DataFrame:
    """Benchmark items as questions of a category."""
    lexical = T.query_expansion(F.col("text")) if category == 1 else F.col("text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), lexical.alias("lexical_query"))


@query(
    f"""WITH {duck.rankers(2)},
j AS (SELECT query_id, note_id, coalesce(b.score, 0.0) AS b, coalesce(e.score, 0.0) AS e FROM (SELECT query_id, note_id FROM q JOIN v USING (past)) p LEFT JOIN dense e USING (query_id, note_id) LEFT JOIN bm25 b USING (query_id, note_id)),
s AS (SELECT query_id, note_id, 0.5 * (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w + 1e-6) + 0.5 * e AS score FROM j WINDOW w AS (PARTITION BY query_id)),
p AS (SELECT * FROM s WHERE score > 0) {duck.top("p", 10)}"""
)
def hybrid_minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half min-max normalised BM25, half cosine of hashed vectors, over the notes that a question may see."""
    top = scan.rank_retrievable(memories(spark, sf_dir), asked(spark, sf_dir, 2), {"hybrid": 10})
    return top.select("query_id", "note_id", "score", "rank")


def _ranked(spark: SparkSession, sf_dir: str, ranker: str, k: int) -> DataFrame:
    found = scan.rank_retrievable(memories(spark, sf_dir), asked(spark, sf_dir, 2), {ranker: k})
    return found.select("query_id", "note_id", "score", "rank")


@query(f"WITH {duck.rankers(2)} {duck.top('lexical', 20)}")
def lexical_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical source: of all documents with a positive score the best of each question."""
    return _ranked(spark, sf_dir, "lexical", 20)


@query(f"WITH {duck.rankers(2)} {duck.top('entity', 20)}")
def entity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity source: of all documents with a positive score the best of each question."""
    return _ranked(spark, sf_dir, "entity", 20)


@query(
    f"""WITH {duck.BM25}, p AS (SELECT query_id, note_id, query, text FROM bm25 JOIN q USING (query_id) JOIN documents t ON t.doc_id = note_id),
s AS (SELECT query_id, note_id, {duck.slot_signal("query", "text")} AS score FROM p) {duck.top("s", 10)}"""
)
def slot_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best answer-slot signals of each question, over all documents that share a token with it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("main"), F.lit("").alias("visual"), F.lit("").alias("speaker"))
    return scan.rank(docs, asked(spark, sf_dir, 2), {"slot": 10}).select("query_id", "note_id", "score", "rank")


def fused(spark: SparkSession, sf_dir: str, category: int, k: int = 10) -> DataFrame:
    """Candidates of every question from all six sources, fused by the weights of a category.

    One scan of the notes ranks them by four rankers for all questions; what follows sees only the candidates.
    """
    notes = memories(spark, sf_dir)
    wanted = asked(spark, sf_dir, category)
    held = scan.retrievable_features(notes, ("path",))
    ranked = scan.rank_retrievable(notes, wanted, R.depths(k, category), held)
    merged = R.merge_sources(R.to_sources(ranked, k, category))
    routes = graph.route(graph.domain_scores(held.select(F.col("path").alias("domain"), "tokens"), questions(spark, sf_dir)))
    routes = routes.groupBy("query_id").agg(F.collect_list("domain").alias("routes"))  # three at most
    joined = merged.join(notes, "note_id").join(wanted, "query_id").join(routes, "query_id", "left")
    signals = {
        "domain_match": T.domain_overlap(F.array("path"), F.col("routes")).cast("double"),
        "reliability": lifecycle.reliability(F.col("success"), F.col("failed"), F.lit(1.0), F.lit(1.0)),
        "citation": lifecycle.citation_score(F.col("citations")),
        "penalty": lifecycle.penalty(F.col("status")),
        "graph_expansion": F.lit(0.0),  # edges are followed only where a caller asks for it: R.expand_by_graph
    }
    ready = joined.withColumns(signals).drop("query", "lexical_query", "visual", "routes")
    return R.fuse(ready, category)


def _fused_sql(category: int, k: int = 10) -> str:
    weights = R.WEIGHTS.get(category, R.WEIGHTS[0])
    total = " + ".join(f"{w} * {s}" for w, s in zip(weights, [*R.SIGNALS[:-1], "lexical_norm"]))
    bonus = "greatest(0.0, 0.04 - 0.02 * (row_number() OVER (PARTITION BY query_id, session ORDER BY first_seen) - 1))" if category == 1 else "0.0"

    def part(name: str, source: str, priority: int, k: int, capped: bool) -> str:
        cap = "max(score) OVER (PARTITION BY query_id)" if capped else "1.0"
        return f"SELECT query_id, note_id, '{name}' AS source, greatest(least(score, {cap}) / greatest({cap}, 1e-6), 1.0 / rank) AS value, {priority} * 1000000 + rank AS seen FROM ({duck.top(source, k)})"

    rows = " UNION ALL ".join(part(name, ranker, p, n, capped) for p, (name, ranker, n, capped) in enumerate(R.source_lists(k, category)))
    values = ", ".join(f"coalesce(max(value) FILTER (source = '{s}'), 0.0) AS {s}" for s in R.SIGNALS[:6])
    penalty = "CASE status WHEN 'candidate' THEN 0.2 WHEN 'stale' THEN 0.4 WHEN 'deprecated' THEN 0.9 WHEN 'archived' THEN 0.8 ELSE 0.0 END"
    return f"""WITH {duck.rankers(category)}, rows AS ({rows}),
m AS (SELECT query_id, note_id, {values}, min(seen) AS first, list_sort(list(DISTINCT source)) AS tags FROM rows GROUP BY query_id, note_id),
dom AS (SELECT path AS domain, count(*) AS n, list_distinct(flatten(list(tokens))) AS words FROM n GROUP BY path),
ds AS (SELECT query_id, domain, n, round({duck.jaccard("qt", "words")}, 6) AS score FROM dom, q),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, domain) AS rank FROM ds),
routes AS (SELECT query_id, list(domain) AS routes FROM dr WHERE rank <= 3 AND (score >= 0.25 OR rank = 1) GROUP BY query_id),
r AS (SELECT m.*, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY m.first) AS INT) AS first_seen, n.session, n.path, n.status, n.success, n.failed, n.citations, n.main, n.low, n.source, q.query, q.lq,
  {duck.common("lt", "tokens")} AS over, {duck.common("lt", "n.seen")} AS vis, len(lt) AS nt, len([p FOR p IN phrases IF contains(low, p)]) AS whole
  FROM m JOIN n USING (note_id) JOIN q ON q.query_id = m.query_id),
c AS (SELECT r.*, CASE WHEN nt = 0 THEN 0.0 ELSE 3.0 * over + 0.75 * vis + (over + 0.5 * vis) / greatest(1, nt) + 0.25 * whole END AS lexical_score, {duck.slot_signal("query", "main")} AS answer_slot,
  CASE WHEN list_contains(routes, path) THEN 1.0 ELSE 0.0 END AS domain_match, (success + 1.0) / (success + failed + 2.0) AS reliability, least(1.0, ln(1.0 + citations) / 5.0) AS citation,
  {penalty} AS penalty, {bonus} AS session_bonus FROM r LEFT JOIN routes USING (query_id)),
e AS (SELECT *, least(1.0, lexical_score / 8.0) AS lexical_norm, CASE WHEN answer_slot > 0 THEN list_sort(list_concat(tags, ['answer_slot'])) ELSE tags END AS source_tags FROM c),
f AS (SELECT *, round(CAST({total} + 0.07 * reliability + 0.03 * citation + session_bonus + 1e-9 AS DOUBLE), 6) AS combined, 0.0 AS graph_expansion FROM e),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY penalty, combined DESC, first_seen) AS INT) AS rank FROM f)"""


_COLUMNS = "query_id, note_id, combined, round(CAST(session_bonus AS DOUBLE), 6) AS session_bonus, array_to_string(source_tags, ',') AS source_tags, first_seen, rank"


def _shown(df: DataFrame, k: int = 10) -> DataFrame:
    return df.where(F.col("rank") <= R.debug_limit(k)).select("query_id", "note_id", "combined", F.round("session_bonus", 6).alias("session_bonus"), F.array_join("source_tags", ",").alias("source_tags"), "first_seen", "rank")


_LIMIT = R.debug_limit(10)


@query(f"{_fused_sql(2)} SELECT {_COLUMNS} FROM fused WHERE rank <= {_LIMIT}")
def fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates kept for inspection, in their final order."""
    return _shown(fused(spark, sf_dir, 2))


@query(f"{_fused_sql(1)} SELECT {_COLUMNS} FROM fused WHERE rank <= {_LIMIT}")
def fused_candidates_cat1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fused(spark, sf_dir, 1))


@query(f"{_fused_sql(4)} SELECT {_COLUMNS} FROM fused WHERE rank <= {_LIMIT}")
def fused_candidates_cat4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fused(spark, sf_dir, 4))


@query(
    f"{_fused_sql(2)} SELECT query_id, note_id, "
    + ", ".join(f"CASE WHEN round(CAST({c} AS DOUBLE), 6) > 0 OR {str(c == 'combined').upper()} THEN CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST({c} AS DOUBLE), 6) DESC, first_seen) AS INT) END AS {c}_rank" for c in R.COMPONENTS)
    + " FROM fused"
)
def component_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's rank by each of the thirteen components."""
    rows = fused(spark, sf_dir, 2)
    return R.component_ranks(rows.withColumns({c: F.round(c, 6) for c in R.COMPONENTS}), R.COMPONENTS)


@query(
    """WITH b AS (SELECT conv_id AS query_id, turn AS note_id, round(length(text) / 7.0, 6) AS score FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id DESC) AS INT) AS rank, max(score) OVER (PARTITION BY query_id) AS cap FROM b)
SELECT query_id, note_id, rank, round(greatest(least(score, cap) / greatest(cap, 1e-6), 1.0 / rank), 6) AS value FROM r WHERE rank <= 5"""
)
def rank_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("note_id"), (F.length("text") / 7.0).alias("score"))
    ranked = R.top_k(rows, 5)
    return R.source(ranked, "s", 0, True).join(ranked.select("query_id", "note_id", "rank"), ["query_id", "note_id"]).select("query_id", "note_id", "rank", F.round("value", 6).alias("value"))


@query(
    """WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn DESC) AS r FROM conversations),
s AS (SELECT conv_id, turn, role, least(CASE WHEN r <= 3 THEN r END, 1000000 + turn) AS seen FROM a)
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seen) AS INT) AS first_seen FROM s"""
)
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order in which two sources name a candidate first: the three longest turns, then all turns."""
    rows = table(spark, sf_dir, "conversations")
    long = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), F.desc("turn")))
    a = rows.withColumn("r", long).where("r <= 3").select("conv_id", "turn", "role", F.col("r").cast("long").alias("seen"))
    seen = a.unionByName(rows.select("conv_id", "turn", "role", (F.col("turn") + 1_000_000).alias("seen"))).groupBy("conv_id", "turn", "role").agg(F.min("seen").alias("seen"))
    return seen.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("seen")).alias("first_seen"))


@query("SELECT conv_id AS query_id, turn AS first_seen, role AS session, round(CAST(greatest(0.0, 0.04 - 0.02 * (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)) AS DOUBLE), 6) AS bonus FROM conversations")
def session_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("first_seen"), F.col("role").alias("session"))
    return rows.select("*", F.round(R.session_bonus("session", 1), 6).alias("bonus"))


@query(
    f"{_fused_sql(2)}, g AS (SELECT b.item_id AS query_id, t.doc_id AS note_id FROM benchmark b JOIN documents t ON contains(t.text, b.text)), ks AS (SELECT unnest(range(10, 51, 5)) AS k) "
    "SELECT CAST(k AS INT) AS k, count(*) AS gold, count(*) FILTER (f.rank <= k) AS found FROM ks, g LEFT JOIN fused f USING (query_id, note_id) GROUP BY k"
)
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold documents found among the first k, for each k of the sweep."""
    ranked = fused(spark, sf_dir, 2).select("query_id", "note_id", "rank")
    held = gold(spark, sf_dir).join(ranked, ["query_id", "note_id"], "left")
    ks = F.explode(F.sequence(F.lit(10), F.lit(50), F.lit(5))).alias("k")
    return held.select(ks, "rank").groupBy("k").agg(F.count(F.lit(1)).alias("gold"), F.count_if(F.col("rank") <= F.col("k")).alias("found"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and the documents that hold them, also inside words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text")
    return dense.containing(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


_COVERAGE = f"""{_fused_sql(1).replace("WITH", "WITH RECURSIVE", 1)},
g AS (SELECT fused.query_id, fused.note_id, fused.rank, combined, first_seen, fused.session, lexical_score, fused.query, fused.main, fused.low, n.tokens,
  regexp_replace(fused.main, '[À-ÖØ-öø-ɏ]', '_', 'g') AS plain FROM fused JOIN n USING (note_id) WHERE rank <= 50),
h AS (SELECT *, {duck.slot_tokens("query", "tokens")} AS st, {duck.slot_kind("query")} AS kind, {duck.entities("plain")} AS ents, {duck.quoted("main")} AS quoted FROM g),
pool AS (SELECT *, {duck.slot_worth()} AS slot_score FROM h),
fold AS (SELECT DISTINCT query_id, 0 AS step, CAST([] AS INT[]) AS chosen, CAST([] AS VARCHAR[]) AS covered, CAST([] AS VARCHAR[]) AS sessions FROM pool
  UNION ALL SELECT query_id, step + 1, list_append(chosen, rank), list_distinct(list_concat(covered, st)), list_append(sessions, session)
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined + 0.025 * least(8, fresh) + 0.075 * least(10.0, slot_score) + 0.025 * least(1.0, lexical_score / 8.0)
      + CASE WHEN seen = 0 THEN 0.035 ELSE 0.0 END - 0.025 * seen - CASE WHEN lexical_score <= 0 AND combined < 0.20 THEN 0.12 ELSE 0.0 END, 9) DESC, fresh DESC, combined DESC, first_seen, note_id) AS rn
    FROM (SELECT fold.query_id, fold.step, fold.chosen, fold.covered, fold.sessions, p.rank, p.st, p.session, p.combined, p.slot_score, p.lexical_score, p.first_seen, p.note_id,
        len([t FOR t IN p.st IF NOT list_contains(fold.covered, t)]) AS fresh, len([x FOR x IN fold.sessions IF x = p.session]) AS seen
      FROM fold JOIN pool p ON p.query_id = fold.query_id WHERE fold.step < 10 AND NOT list_contains(fold.chosen, p.rank))) WHERE rn = 1),
done AS (SELECT query_id, arg_max(chosen, step) AS chosen FROM fold GROUP BY query_id)
SELECT query_id, note_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN list_contains(chosen, rank) THEN list_position(chosen, rank) ELSE 1000 + rank END) AS INT) AS position FROM pool JOIN done USING (query_id)"""


@query(_COVERAGE)
def coverage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category 1: the pool of each question in coverage order; the twin picks by recursion."""
    rows = _with_slots(spark, sf_dir, fused(spark, sf_dir, 1))
    return bundle.coverage_rerank(rows, 10)


def _with_slots(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    pool = rows.where(F.col("rank") <= 50)
    joined = pool.withColumnRenamed("main", "text").join(questions(spark, sf_dir).select("query_id", "query"), "query_id")
    return joined.select(
        "query_id", "note_id", "rank", "combined", "first_seen", "session", "lexical_score",
        bundle.slot_tokens(F.col("query"), F.col("text")).alias("slot_tokens"), bundle.slot_score(F.col("query"), F.col("text")).alias("slot_score"),
    )


_PACKED = f"""{_fused_sql(2).replace("WITH", "WITH RECURSIVE", 1)},
pool AS (SELECT query_id, note_id, rank, lexical_score FROM fused WHERE rank <= 20),
near AS (SELECT query_id, note_id, list({{'target': target, 'worth': 3.0 * over + over / greatest(1, nq)}} ORDER BY pos) AS beside
  FROM (SELECT p.query_id, p.note_id, s.pos, t.note_id AS target, {duck.common("q.qt", "t.tokens")} AS over, len(q.qt) AS nq
    FROM pool p, (VALUES (-1, 1), (1, 2)) s(d, pos) JOIN n t ON t.note_id = p.note_id + s.d JOIN q ON q.query_id = p.query_id WHERE p.rank <= 2) GROUP BY query_id, note_id),
fold AS (SELECT DISTINCT query_id, 0 AS rank, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS relations, 0 AS primaries, FALSE AS full_ FROM pool
  UNION ALL SELECT query_id, rank, CASE WHEN skip THEN ids WHEN pick IS NULL THEN list_append(ids, note_id) ELSE list_concat(ids, [note_id, pick]) END,
    CASE WHEN skip THEN relations WHEN pick IS NULL THEN list_append(relations, 'primary') ELSE list_concat(relations, ['primary', 'local_context']) END, CASE WHEN skip THEN primaries ELSE primaries + 1 END,
    NOT skip AND (primaries + 1 >= 6 OR len(ids) + 1 + CASE WHEN pick IS NULL THEN 0 ELSE 1 END >= 10)
  FROM (SELECT fold.query_id, p.rank, p.note_id, fold.ids, fold.relations, fold.primaries, list_contains(fold.ids, p.note_id) AS skip,
      CASE WHEN fold.primaries < 2 AND p.lexical_score >= 2.0 AND len(fold.ids) + 1 < 10 THEN ([b.target FOR b IN coalesce(near.beside, []) IF b.worth >= 1.0 AND b.target <> p.note_id AND NOT list_contains(fold.ids, b.target)])[1] END AS pick
    FROM fold JOIN pool p ON p.query_id = fold.query_id AND p.rank = fold.rank + 1 LEFT JOIN near ON near.query_id = p.query_id AND near.note_id = p.note_id WHERE NOT fold.full_)),
done AS (SELECT query_id, arg_max(ids, rank) AS ids, arg_max(relations, rank) AS relations FROM fold GROUP BY query_id)
SELECT query_id, CAST(unnest(range(1, len(ids) + 1)) AS INT) AS block_pos, unnest(ids) AS note_id, unnest(relations) AS relation FROM done"""


@query(_PACKED)
def bundle_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of each question; a document's neighbours are the documents of the next smaller and larger id."""
    ranked = fused(spark, sf_dir, 2).select("query_id", "note_id", "rank", "lexical_score")
    docs = documents(spark, sf_dir).select("note_id", "tokens")
    asked = questions(spark, sf_dir).select("query_id", F.col("tokens").alias("query_tokens"))
    steps = F.explode(F.array(F.struct(F.lit(-1).alias("d"), F.lit(1).alias("pos")), F.struct(F.lit(1).alias("d"), F.lit(2).alias("pos")))).alias("s")
    near = ranked.where("rank <= 2").select("query_id", "note_id", steps).select("query_id", "note_id", "s.pos", (F.col("note_id") + F.col("s.d")).alias("target_id"))
    near = near.join(docs.withColumnRenamed("note_id", "target_id"), "target_id").join(asked, "query_id")
    overlap = T.n_common(F.col("query_tokens"), F.col("tokens"))
    near = near.select("query_id", "note_id", "pos", "target_id", (3.0 * overlap + overlap / F.greatest(F.lit(1), F.size("query_tokens"))).alias("lexical_score"))
    return bundle.bundles(ranked, near, 2, 10)


@query(
    """WITH p AS (SELECT doc_id, source || ' / ' || lang AS path, text AS example FROM documents),
l AS (SELECT doc_id, example, unnest([split_part(path, ' / ', 1), path]) AS domain FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS rn FROM l)
SELECT domain, count(*) AS n, array_to_string(list(example ORDER BY rn) FILTER (rn <= 3), '|') AS examples FROM r GROUP BY domain"""
)
def domain_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.concat_ws(" / ", "source", "lang").alias("domain_path"), F.col("text").alias("example"))
    return graph.domain_catalog(docs).select("domain", "n", F.array_join("examples", "|").alias("examples"))


@query(
    f"""WITH p AS (SELECT source || ' / ' || lang AS domain, count(*) AS n, list_distinct(flatten(list({duck.retrieval("text")}))) AS tokens FROM documents GROUP BY ALL),
q AS (SELECT item_id AS query_id, {duck.retrieval("text")} AS tokens FROM benchmark),
s AS (SELECT query_id, domain, n, round({duck.jaccard("q.tokens", "p.tokens")}, 6) AS score FROM p, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, domain) AS INT) AS rank FROM s)
SELECT query_id, domain, n, score, rank FROM r WHERE rank <= 3 AND (score >= 0.25 OR rank = 1)"""
)
def domain_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of each question by token overlap with all texts of their documents."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(" / ", "source", "lang").alias("domain"), T.retrieval_tokens(F.col("text")).alias("tokens"))
    return graph.route(graph.domain_scores(docs, questions(spark, sf_dir).select("query_id", "tokens"))).select("query_id", "domain", "n", "score", "rank")


@query(
    """WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS s, count(*) FILTER (event_type = 'error') AS x, count(*) FILTER (event_type = 'view') AS c FROM events GROUP BY user_id)
SELECT user_id, round((s + 1.0) / (s + x + 2.0), 6) AS reliability, round(least(1.0, ln(1.0 + c) / 5.0), 6) AS citation FROM f"""
)
def reliability_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("purchase", "error", "view")])
    return seen.select("user_id", F.round(lifecycle.reliability(F.col("purchase"), F.col("error"), F.lit(1.0), F.lit(1.0)), 6).alias("reliability"), F.round(lifecycle.citation_score(F.col("view")), 6).alias("citation"))
