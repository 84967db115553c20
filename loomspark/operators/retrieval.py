"""Scoring and ranking of notes against questions, as joins, grouped sums and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T

# BM25 parameters, candidate depths and the fusion weights of each question category.
K1, B = 1.5, 0.75
SEED_TOP_K, GLOBAL_DENSE, GLOBAL_BM25, GLOBAL_ENTITY, EXPANDED = 20, 5, 15, 10, 40
SIGNALS = ["domain_embedding", "domain_bm25", "domain_lexical", "global_embedding", "global_bm25", "global_entity", "answer_slot", "domain_match", "lexical"]
WEIGHTS = {
    4: [0.10, 0.15, 0.15, 0.05, 0.30, 0.25, 0.12, 0.05, 0.20],
    1: [0.18, 0.18, 0.18, 0.07, 0.22, 0.18, 0.14, 0.08, 0.18],
    0: [0.25, 0.18, 0.12, 0.08, 0.18, 0.14, 0.12, 0.10, 0.18],
}
RELIABILITY_WEIGHT, CITATION_WEIGHT = 0.07, 0.03
ACTIONS = ("research", "apply", "paint", "read", "camp", "support", "birthday", "identity", "beach", "conference", "meeting")


def index_stats(notes: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: n_docs and avgdl."""
    return notes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens)).alias("avgdl"))


def document_frequency(notes: DataFrame, tokens: str = "tokens") -> DataFrame:
    return notes.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25(notes: DataFrame, questions: DataFrame, note_id: str = "note_id", query_id: str = "query_id") -> DataFrame:
    """query_id, note_id, score of every pair that shares a token.

    notes have a set of tokens, as questions do; a token counts once for a note. Only tokens that
    some question asks for leave the scan of the notes; their frequencies are counted on what is left.
    """
    asked = questions.select(F.col(query_id).alias("query_id"), F.explode("tokens").alias("token"))
    wanted = asked.select("token").distinct()
    held = notes.select(F.col(note_id).alias("note_id"), F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    hits = held.join(wanted, "token", "left_semi")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = index_stats(notes)
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.crossJoin(F.broadcast(stats)).select("token", idf.alias("idf"), "avgdl")  # one row
    terms = asked.join(weighted, "token")
    part = F.col("idf") * (K1 + 1.0) / (1.0 + K1 * (1.0 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-6))))
    return hits.join(terms, "token").groupBy("query_id", "note_id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, partition: str = "query_id", note_id: str = "note_id", digits: int = 6) -> DataFrame:
    """The k best of each query with rank from 1: by rounded score, then the larger id."""
    rounded = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(partition).orderBy(F.desc("score"), F.desc(note_id))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for an empty or zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit(v: Column) -> Column:
    """A vector scaled to length 1, as doubles; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def lexical_relevance(query: Column, main: Column, visual: Column) -> Column:
    """Weighted token overlap with main and visual text, coverage, and a bonus for whole phrases."""
    q, m, v = T.retrieval_tokens(query), T.retrieval_tokens(main), T.retrieval_tokens(visual)
    over, seen = T.n_common(q, m), T.n_common(q, v)
    phrases = F.filter(F.transform(F.split(F.lower(query), "[,;?]+"), lambda p: F.trim(p)), lambda p: (F.length(p) >= 8) & F.lower(main).contains(p))
    score = 3.0 * over + 0.75 * seen + (over + 0.5 * seen) / F.greatest(F.lit(1), F.size(q)) + 0.25 * F.size(phrases)
    return F.when(F.size(q) > 0, score).otherwise(0.0)


def names(query: Column) -> Column:
    """Capitalised words of a question, each once."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?U)\b[A-Z][a-z]+(?:'[a-z]+)?\b"), F.lit(0)))


def entity_score(query: Column, speaker: Column, exact: Column) -> Column:
    """Overlap, tokens found as substrings, names, and action words in both."""
    q, low, asked = T.retrieval_tokens(query), F.lower(exact), F.lower(query)
    named = F.filter(names(query), lambda n: (F.lower(n) == F.lower(speaker)) | low.contains(F.lower(n)))
    inside = F.filter(q, lambda t: low.contains(t))
    acts = reduce(lambda s, a: s + F.when(asked.contains(a) & low.contains(a), 1.5).otherwise(0.0), ACTIONS, F.lit(0.0))
    score = 2.0 * T.n_common(q, T.retrieval_tokens(exact)) + 0.25 * F.size(inside) + F.size(named) + acts
    return F.when(F.size(q) > 0, score).otherwise(0.0)


def slot_signal(query: Column, rewrite: Column) -> Column:
    """How well a rewrite offers the answer slots of the question: 0 to 1."""
    tokens = T.retrieval_tokens(rewrite)
    hits = F.size(F.filter(T.slot_terms(query), lambda s: F.lower(rewrite).contains(s) | (F.size(F.array_intersect(F.split(s, " "), tokens)) > 0)))
    colon = F.when(rewrite.contains(":") & (hits > 0), 0.10).otherwise(0.0)
    overlap = T.n_common(T.retrieval_tokens(query), tokens)
    return F.least(F.lit(1.0), 0.18 * F.least(F.lit(5), overlap) + 0.28 * F.least(F.lit(2), hits) + colon)


def offered_slots(text: Column, tokens: Column) -> Column:
    """Slots whose name, or a word of it, a text holds."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(s) | F.arrays_overlap(tokens, F.array(*map(F.lit, s.split(" ")))), s) for s in T.SLOT_PATTERNS]))


def rank_score(score: Column, rank: Column, cap: Column) -> Column:
    """A source's score for fusion: its capped share or the reciprocal rank (rank from 1), whichever is more."""
    return F.greatest(F.least(score, cap) / F.greatest(cap, F.lit(1e-6)), 1.0 / rank)


def source(ranked: DataFrame, name: str, priority: int, capped: bool) -> DataFrame:
    """One ranked list in the form that merge_sources() takes."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    cap = F.when(best == 0, 1.0).otherwise(best) if capped else F.lit(1.0)
    return ranked.select("query_id", "note_id", F.lit(name).alias("source"), rank_score(F.col("score"), F.col("rank"), cap).alias("value"), (F.lit(priority) * 1_000_000 + F.col("rank")).alias("seen"))


def source_lists(k: int, category: int) -> list[tuple[str, str, int, bool]]:
    """Name, ranker, length and whether scores are capped by the best, of each source in the order in which candidates are first seen."""
    near, wide = depth(k, category), category == 1
    g_dense, g_bm25, g_entity = (max(n, EXPANDED) if wide else n for n in (GLOBAL_DENSE, GLOBAL_BM25, GLOBAL_ENTITY))
    return [
        ("domain_embedding", "dense", near, False), ("domain_bm25", "bm25", near, True), ("domain_lexical", "lexical", near, True),
        ("global_embedding", "dense", g_dense, False), ("global_bm25", "bm25", g_bm25, True), ("global_entity", "entity", g_entity, True),
    ]


def depths(k: int, category: int) -> dict[str, int]:
    """How far each ranker must rank for all sources that it feeds."""
    out: dict[str, int] = {}
    for _, ranker, n, _ in source_lists(k, category):
        out[ranker] = max(n, out.get(ranker, 0))
    return out


def to_sources(ranked: DataFrame, k: int, category: int) -> DataFrame:
    """Rows of rankers (query_id, note_id, ranker, score, rank) as rows of sources, in one pass: each to every source that it feeds."""
    best = F.max("score").over(Window.partitionBy("query_id", "ranker"))
    row = lambda name, seen, cap: F.struct(F.lit(name).alias("source"), rank_score(F.col("score"), F.col("rank"), cap).alias("value"), (F.lit(seen) * 1_000_000 + F.col("rank")).alias("seen"))
    fed = [F.when((F.col("ranker") == ranker) & (F.col("rank") <= n), row(name, p, F.col("best") if capped else F.lit(1.0))) for p, (name, ranker, n, capped) in enumerate(source_lists(k, category))]
    capped = ranked.withColumn("best", F.when(best == 0, 1.0).otherwise(best))
    told = [c for c in ("lexical_score", "answer_slot") if c in ranked.columns]
    return capped.select("query_id", "note_id", *told, F.explode(F.array_compact(F.array(*fed))).alias("s")).select("query_id", "note_id", *told, "s.source", "s.value", "s.seen")


def depth(k: int, category: int) -> int:
    return max(SEED_TOP_K, 4 * k, EXPANDED if category == 1 else 0)


def merge_sources(rows: DataFrame) -> DataFrame:
    """Largest value of each source for each candidate, its tags, and the order in which candidates were first seen."""
    values = [F.coalesce(F.max(F.when(F.col("source") == s, F.col("value"))), F.lit(0.0)).alias(s) for s in SIGNALS[:6]]
    told = [F.max(c).alias(c) for c in ("lexical_score", "answer_slot") if c in rows.columns]  # the same for a pair whatever its source
    merged = rows.groupBy("query_id", "note_id").agg(*values, *told, F.min("seen").alias("seen"), F.array_sort(F.collect_set("source")).alias("source_tags"))
    return merged.withColumn("first_seen", F.row_number().over(Window.partitionBy("query_id").orderBy("seen")))


def session_bonus(session: str, category: int) -> Column:
    """Category 1: 0.04, less 0.02 for each earlier candidate of the session, not below 0."""
    if category != 1:
        return F.lit(0.0)
    earlier = F.row_number().over(Window.partitionBy("query_id", session).orderBy("first_seen")) - 1
    return F.when(F.col(session).isNotNull(), F.greatest(F.lit(0.0), 0.04 - 0.02 * earlier)).otherwise(0.0)


def fuse(candidates: DataFrame, category: int, session: str = "session") -> DataFrame:
    """combined and rank of merged candidates that carry answer_slot, domain_match, lexical_score, reliability, citation and penalty."""
    weights = WEIGHTS.get(category, WEIGHTS[0])
    candidates = candidates.withColumn("lexical_norm", F.least(F.lit(1.0), F.col("lexical_score") / 8.0))
    tagged = F.when(F.col("answer_slot") > 0, F.array_sort(F.array_union("source_tags", F.array(F.lit("answer_slot"))))).otherwise(F.col("source_tags"))
    candidates = candidates.withColumn("source_tags", tagged)
    signals = {s: F.col(s) for s in SIGNALS[:-1]} | {"lexical": F.col("lexical_norm")}
    total = reduce(lambda s, k: s + F.lit(weights[k]) * signals[SIGNALS[k]], range(1, len(SIGNALS)), F.lit(weights[0]) * signals[SIGNALS[0]])
    total = total + RELIABILITY_WEIGHT * F.col("reliability") + CITATION_WEIGHT * F.col("citation") + F.col("session_bonus")
    scored = candidates.withColumn("session_bonus", session_bonus(session, category)).withColumn("combined", F.round(total + 1e-9, 6))
    order = Window.partitionBy("query_id").orderBy("penalty", F.desc("combined"), "first_seen")
    return scored.withColumn("rank", F.row_number().over(order))


#: What a candidate is ranked by for inspection; a source's own value, a signal of the note, or the combined score.
COMPONENTS = [
    "domain_embedding", "domain_bm25", "domain_lexical", "global_embedding", "global_bm25", "global_entity", "graph_expansion", "answer_slot", "domain_match",
    "lexical_norm", "reliability", "citation", "combined",
]


def debug_limit(k: int, bundle: int = 10) -> int:
    """Candidates of a question that are kept for inspection."""
    return max(100, 10 * k, bundle)


def pre_graph_score() -> Column:
    """What candidates are worth before edges are followed."""
    # The weights of the sources.
    weights = {"domain_embedding": 0.25, "domain_bm25": 0.20, "domain_lexical": 0.16, "global_embedding": 0.12, "global_bm25": 0.20, "global_entity": 0.18}
    return reduce(lambda s, k: s + F.lit(weights[k]) * F.col(k), list(weights)[1:], F.lit(weights["domain_embedding"]) * F.col("domain_embedding"))


# Relations that an expansion follows with their weights; by category the relations left out, seeds, targets of a seed and targets in all.
RELATION_WEIGHTS = {"same_storyline": 0.95, "similar_event": 0.72, "image_text_pair": 0.55, "same_character": 0.45}
EXPANSION = {1: ((), 20, 3, 36), 2: ((), 10, 2, 16), 4: (("same_character",), 8, 1, 10), 0: ((), 10, 2, 12)}


def expand_by_graph(candidates: DataFrame, edges: DataFrame, category: int) -> DataFrame:
    """query_id, note_id, graph_expansion, tag: the targets of the best candidates' edges.

    candidates: query_id, note_id, first_seen and the six sources' values; edges: query_id, src_id, target_id,
    relation, strength, lexical_score and ord (of the target, which is retrievable). Seeds go by their score before
    the graph; of a seed the best targets follow, until all seeds together have as many as the category allows.
    """
    left_out, seeds, per_seed, most = EXPANSION.get(category, EXPANSION[0])
    worth = candidates.select("query_id", F.col("note_id").alias("src_id"), "first_seen", pre_graph_score().alias("worth"))
    seed = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("worth"), "first_seen"))
    seeds_of = worth.withColumn("seed", seed).where(F.col("seed") <= seeds)
    weight = reduce(lambda rest, r: F.when(F.col("relation") == r, RELATION_WEIGHTS[r]).otherwise(rest), RELATION_WEIGHTS, F.lit(None).cast("double"))
    near = F.lit(True)
    if category == 4:
        near = F.col("lexical_score") >= 1.0
    elif category == 2:
        near = F.col("relation").isin("same_storyline", "image_text_pair") | (F.col("lexical_score") >= 1.0)
    usable = edges.withColumn("weight", weight).where(F.col("weight").isNotNull() & ~F.col("relation").isin(*left_out, "") & (F.col("src_id") != F.col("target_id")) & near)
    value = F.greatest(F.lit(0.15), F.col("worth")) * F.col("strength") * F.col("weight") * (1.0 + F.least(F.lit(1.0), F.col("lexical_score") / 8.0))
    scored = seeds_of.join(usable, ["query_id", "src_id"]).withColumn("value", value)
    place = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("value"), F.desc("relation"), F.desc("ord")))
    kept = scored.withColumn("place", place).where(F.col("place") <= per_seed)
    total = F.row_number().over(Window.partitionBy("query_id").orderBy("seed", "place"))
    kept = kept.withColumn("total", total).where(F.col("total") <= most)
    return kept.groupBy("query_id", F.col("target_id").alias("note_id")).agg(F.max("value").alias("graph_expansion"), F.concat(F.lit("graph_"), F.max_by("relation", "value")).alias("tag"))


def component_ranks(fused: DataFrame, components: list[str]) -> DataFrame:
    """Rank of each component within its query, ties in the order first seen; null where the value is not positive, but for combined."""
    one = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "first_seen"))
    ranks = [F.when((F.col(c) > 0) | F.lit(c == "combined"), one(c)).alias(f"{c}_rank") for c in components]
    return fused.select("query_id", "note_id", *ranks)


def min_max(column: str, partition: list[str]) -> Column:
    """(x - min) / (max - min + 1e-6) within the partition."""
    over = Window.partitionBy(*partition)
    low, high = F.min(column).over(over), F.max(column).over(over)
    return (F.col(column) - low) / (high - low + 1e-6)
