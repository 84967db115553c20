"""Typed edges between notes and the domain tree over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import lifecycle, overlap
from loomspark.sources import scratch

EDGE = ["sample_id", "src_id", "target_id", "relation", "strength"]
TYPED_CAP, SIMILAR_CAP = 8, 4


def same_character(notes: DataFrame) -> DataFrame:
    """Both directions between a speaker's neighbouring notes, notes without a turn id last."""
    order = Window.partitionBy("sample_id", "speaker").orderBy(F.asc_nulls_last("session"), F.asc_nulls_last("turn"), "ord")
    pairs = notes.where("speaker <> ''").select("sample_id", F.col("note_id").alias("a"), F.lead("note_id").over(order).alias("b")).where("b IS NOT NULL")
    both = F.explode(F.array(F.struct(F.col("a").alias("src_id"), F.col("b").alias("target_id")), F.struct(F.col("b").alias("src_id"), F.col("a").alias("target_id"))))
    return pairs.select("sample_id", both.alias("e")).select("sample_id", "e.src_id", "e.target_id", F.lit("same_character").alias("relation"), F.lit(0.4).alias("strength"))


def local_neighbours(notes: DataFrame, radius: int) -> DataFrame:
    """Notes up to radius turns away in the session, nearest first, the earlier turn first; of a repeated turn the later note counts."""
    lookup = notes.groupBy("sample_id", "session", "turn").agg(F.max_by("note_id", "ord").alias("target_id"))
    steps = F.array(*[F.struct(F.lit(s * d).alias("step"), F.lit(2 * d + (s > 0)).alias("place")) for d in range(1, radius + 1) for s in (-1, 1)])
    asked = notes.select("sample_id", "session", F.col("note_id").alias("src_id"), F.col("turn").alias("at"), F.explode(steps).alias("s"))
    asked = asked.select("sample_id", "session", "src_id", (F.col("at") + F.col("s.step")).alias("turn"), "s.place")
    found = asked.join(lookup, ["sample_id", "session", "turn"])
    rank = F.row_number().over(Window.partitionBy("sample_id", "src_id").orderBy("place"))
    return found.select("sample_id", "src_id", "target_id", rank.alias("pos"))


def pair_features(notes: DataFrame, nearby: int = 4) -> DataFrame:
    """Pairs of a sample's notes that an edge rule can hold for, found by shared cues, rare tokens or nearness of turns, never by all pairs.

    notes: sample_id, note_id, ord, session, turn, speaker, tokens (set), cues, strong, visual (sets).
    """
    side = lambda p: notes.select("sample_id", *[F.col(c).alias(f"{p}_{c}") for c in ("note_id", "ord", "session", "turn", "speaker", "tokens", "cues", "strong", "visual")])
    a, b = side("a"), side("b")
    # similar events across sessions share half of their tokens, so they share one of each note's rarest half: common tokens make no pairs
    held = notes.select("sample_id", "note_id", "ord", F.size("tokens").alias("n"), F.explode("tokens").alias("cue"))
    often = held.groupBy("sample_id", "cue").agg(F.count(F.lit(1)).alias("often"))
    rare = F.row_number().over(Window.partitionBy("sample_id", "note_id").orderBy("often", "cue"))
    prefix = held.join(often, ["sample_id", "cue"]).withColumn("r", rare).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") / 2) + 1).select("sample_id", "note_id", "ord", "cue")
    spoken = notes.select("sample_id", "note_id", "ord", F.explode(F.array_union("cues", "visual")).alias("cue")).union(prefix)
    left = spoken.select("sample_id", F.col("note_id").alias("a_note_id"), F.col("ord").alias("a_o"), "cue")
    right = spoken.select("sample_id", F.col("note_id").alias("b_note_id"), F.col("ord").alias("b_o"), "cue")
    pairs = left.join(right, ["sample_id", "cue"]).where("a_o < b_o").select("sample_id", "a_note_id", "b_note_id").distinct()
    near = notes.select("sample_id", F.col("note_id").alias("a_note_id"), "session", "ord", F.explode(F.sequence(F.col("turn") - nearby, F.col("turn") + nearby)).alias("turn"))
    near = near.join(notes.select("sample_id", "session", "turn", F.col("note_id").alias("b_note_id"), F.col("ord").alias("b_o")), ["sample_id", "session", "turn"])
    pairs = pairs.union(near.where("ord < b_o").select("sample_id", "a_note_id", "b_note_id")).distinct()
    return pairs.join(a, ["sample_id", "a_note_id"]).join(b, ["sample_id", "b_note_id"])


def storyline_edges(pairs: DataFrame) -> DataFrame:
    """same_storyline and image_text_pair edges of the pairs, before caps; similarity is the Jaccard of the token sets."""
    both = T.n_common(F.col("a_tokens"), F.col("b_tokens"))
    like = T.jaccard(F.col("a_tokens"), F.col("b_tokens"))
    same = (F.col("a_speaker") != "") & (F.col("a_speaker") == F.col("b_speaker"))
    people = F.array(F.lit("caroline"), F.lit("melanie"), F.lower("a_speaker"), F.lower("b_speaker"))
    strong = F.size(F.array_intersect("a_strong", "b_strong"))
    shared = F.size(F.array_except(F.array_intersect("a_cues", "b_cues"), people))
    later = (F.col("a_session") < F.col("b_session")) & F.col("a_session").isNotNull() & F.col("b_session").isNotNull()
    allowed = (same & (strong > 0)) | (same & (shared >= 2)) | (~same & (strong >= 2)) | (later & (strong > 0) & ((both >= 1) | (like >= 0.35)))
    kept = allowed & ((both >= 1) | (like >= 0.25) | (strong > 0))
    story = F.least(F.lit(0.92), 0.60 + 0.08 * F.least(F.lit(3), strong) + 0.04 * F.least(F.lit(3), shared) + F.when(same, 0.08).otherwise(0.0) + F.when(later, 0.04).otherwise(0.0))
    nearby = (F.col("a_session") == F.col("b_session")) & (F.abs(F.col("a_turn") - F.col("b_turn")) <= 4)
    seen = F.array_union(F.array_intersect("a_visual", "b_cues"), F.array_intersect("b_visual", "a_cues"))
    visual = F.size(F.array_except(seen, F.array(F.lower("a_speaker"), F.lower("b_speaker"))))
    pictured = nearby & (visual > 0) & ((both >= 1) | (like >= 0.20))
    found = F.array_compact(
        F.array(
            F.when(kept, F.struct(F.lit("same_storyline").alias("relation"), story.alias("strength"), F.lit(0).alias("k"))),
            F.when(pictured, F.struct(F.lit("image_text_pair").alias("relation"), F.least(F.lit(0.86), 0.58 + 0.08 * F.least(F.lit(3), visual)).alias("strength"), F.lit(1).alias("k"))),
        )
    )
    return pairs.select("sample_id", "a_note_id", "b_note_id", "a_ord", "b_ord", F.explode(found).alias("e")).select("sample_id", "a_note_id", "b_note_id", "a_ord", "b_ord", "e.relation", "e.strength", "e.k")


def cap_typed(edges: DataFrame, cap: int = TYPED_CAP) -> DataFrame:
    """Both directions of typed pair edges, at most cap for each source, in the order of the pairs."""
    row = lambda s, t: F.struct(F.col(f"{s}_note_id").alias("src_id"), F.col(f"{t}_note_id").alias("target_id"))
    both = edges.select("sample_id", "a_ord", "b_ord", "k", "relation", "strength", F.explode(F.array(row("a", "b"), row("b", "a"))).alias("e")).select("*", "e.src_id", "e.target_id")
    rank = F.row_number().over(Window.partitionBy("sample_id", "src_id").orderBy("a_ord", "b_ord", "k"))
    return both.withColumn("_n", rank).where(F.col("_n") <= cap).select(*EDGE)


def capped_matching(pairs: DataFrame, cap: int) -> DataFrame:
    """Of ordered pairs those that a fold takes which takes a pair while both of its ends have fewer than cap.

    pairs: sample_id, a_note_id, b_note_id, a_ord, b_ord and more; the order is that of (a_ord, b_ord), a pair occurs once. Equal to the
    fold, but not one: in each round every pair is taken whose ends have room even if all open pairs before it were taken, and
    every pair goes one of whose ends is full by pairs before it. The first open pair of a sample is always decided, and pairs that share no
    open pair before them are decided side by side. A pair has a row at either end, so a sample is spread over its notes.
    """
    keys, more = ["sample_id", "a_note_id", "b_note_id"], [c for c in pairs.columns if c not in ("sample_id", "a_note_id", "b_note_id")]
    state = scratch.materialise(pairs.withColumn("_taken", F.lit(None).cast("boolean")), "matching")
    before = Window.partitionBy("sample_id", "_end").orderBy("a_ord", "b_ord").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(before), F.lit(0))
    while not state.where("_taken IS NULL").isEmpty():
        ends = state.withColumn("_end", F.explode(F.array("a_note_id", "b_note_id")))
        taken = F.coalesce(F.col("_taken"), F.lit(False))
        seen = ends.withColumns({"_full": count(taken) >= cap, "_room": count(taken | F.col("_taken").isNull()) < cap})
        both = seen.groupBy(*keys).agg(*[F.first(c).alias(c) for c in (*more, "_taken")], F.bool_or("_full").alias("_full"), F.bool_and("_room").alias("_room"))
        judged = both.withColumn("_taken", F.coalesce("_taken", F.when(F.col("_full"), False).when(F.col("_room"), True)))
        # a pair that goes is counted nowhere, so only the taken and the open ones go on
        rest = scratch.materialise(judged.where("coalesce(_taken, true)").select(*keys, *more, "_taken"), "matching")
        scratch.discard(state)
        state = rest
    return state.drop("_taken")


def similar_events(pairs: DataFrame, cap: int = SIMILAR_CAP) -> DataFrame:
    """similar_event edges with at most cap at either end, taken in the order of the pairs."""
    both, like = T.n_common(F.col("a_tokens"), F.col("b_tokens")), T.jaccard(F.col("a_tokens"), F.col("b_tokens"))
    nearby = (F.col("a_session") == F.col("b_session")) & (F.abs(F.col("a_turn") - F.col("b_turn")) <= 4)
    across = (F.col("a_session") != F.col("b_session")) & (F.col("a_speaker") != "") & (F.col("a_speaker") == F.col("b_speaker"))
    weight = F.when(nearby & ((both >= 2) | (like >= 0.60)), 1.0).when(across & (both >= 3) & (like >= 0.50), 0.6)
    rows = pairs.select("sample_id", "a_note_id", "b_note_id", "a_ord", "b_ord", weight.alias("strength")).where("strength IS NOT NULL")
    row = lambda s, t: F.struct(F.col(f"{s}_note_id").alias("src_id"), F.col(f"{t}_note_id").alias("target_id"))
    taken = capped_matching(rows, cap).select("sample_id", "strength", F.explode(F.array(row("a", "b"), row("b", "a"))).alias("e"))
    return taken.select("sample_id", "e.src_id", "e.target_id", F.lit("similar_event").alias("relation"), "strength")


def upsert_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge for each source, target and relation of a sample, with the largest strength; forbidden and unknown relations and loops go.

    What else an edge carries (reason, target_dia_id, created_at) is that of the first by the column order, as later ones only
    strengthen it. Without an order the earliest created_at counts as first, and what is then equal goes by its value.
    """
    keys = [c for c in ("sample_id", "src_id", "target_id", "relation") if c in edges.columns]
    more = [c for c in ("reason", "target_dia_id", "created_at") if c in edges.columns]
    kept = edges.where(F.col("relation").isin(*lifecycle.RELATIONS) & (F.col("src_id") != F.col("target_id")))
    if not more:
        return kept.groupBy(*keys).agg(F.max("strength").alias("strength"))
    by = [c for c in (order, "created_at") if c and c in edges.columns]
    first = F.min(F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], *[F.col(c) for c in more])).alias("first")
    return kept.groupBy(*keys).agg(F.max("strength").alias("strength"), first).select(*keys, "strength", *[F.col(f"first.{c}").alias(c) for c in more])


def best_overlap(notes: DataFrame) -> DataFrame:
    """sample_id, note_id, best_id, overlap: of the earlier notes of the sample that share a token, the first of largest Jaccard overlap.

    notes: sample_id, note_id, ord, tokens (set). Tokens that many notes hold make no pairs (``overlap``).
    """
    asked = notes.select("sample_id", F.col("note_id").alias("ask_id"), "ord", "tokens")
    best = overlap.nearest(asked, asked, 1, earlier=True)
    return best.select("sample_id", F.col("ask_id").alias("note_id"), F.col("note_id").alias("best_id"), "overlap")


def resolve_targets(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """target of each edge: by target_id, else by position."""
    by_id = notes.select("sample_id", F.col("note_id").alias("target_id"), F.col("note_id").alias("by_id"))
    by_place = notes.select("sample_id", F.col("ord").alias("target_index"), F.col("note_id").alias("by_place"))
    return edges.join(by_id, ["sample_id", "target_id"], "left").join(by_place, ["sample_id", "target_index"], "left").withColumn("target", F.coalesce("by_id", "by_place")).drop("by_id", "by_place")


def domain_catalog(notes: DataFrame, path: str = "domain_path", example: str = "example", order: str = "note_id") -> DataFrame:
    """Each level of each path: its notes and its first three examples. Of each level only three rows are shuffled from a task."""
    levels = notes.select(F.explode(T.domain_prefixes(F.col(path))).alias("domain"), F.col(order).alias("_o"), F.col(example).alias("_e"))
    counts = levels.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    first = levels.withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy("_o"))).where("_r <= 3")
    texts = first.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_e"))), lambda x: x["_e"]).alias("examples"))
    return counts.join(texts, "domain")


def domain_scores(notes: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, domain, n, score: Jaccard of a question's tokens and the vocabulary of each domain that shares one.

    notes: domain, tokens; questions: query_id, tokens. A vocabulary is rows, never one value, and is written once: its size and what it
    shares give the union. A question that no domain shares a token with gets the domain of most notes, with score 0.
    """
    counts = notes.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    words = scratch.materialise(notes.select("domain", F.explode("tokens").alias("token")).distinct(), "domain-words")
    sizes = words.groupBy("domain").agg(F.count(F.lit(1)).alias("words"))
    asked = questions.select("query_id", F.size("tokens").alias("asked"), F.explode("tokens").alias("token"))
    shared = asked.join(words, "token").groupBy("query_id", "domain", "asked").agg(F.count(F.lit(1)).alias("common"))
    scored = shared.join(sizes, "domain").join(counts, "domain").select("query_id", "domain", "n", F.round(F.col("common") / (F.col("asked") + F.col("words") - F.col("common")), 6).alias("score"))
    best = counts.orderBy(F.desc("n"), "domain").limit(1).select("domain", "n", F.lit(0.0).alias("score"))
    alone = questions.select("query_id").join(shared.select("query_id"), "query_id", "left_anti").crossJoin(F.broadcast(best))  # one row
    return scored.unionByName(alone)


def route(scored: DataFrame, k: int = 3, threshold: float = 0.25) -> DataFrame:
    """Domains by score and count: those over the threshold up to k, else the best one."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("n"), "domain")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & ((F.col("score") >= threshold) | (F.col("rank") == 1)))
