"""Order-dependent steps over one question's ranked candidates: coverage rerank and bundle packing.

Both see a bounded pool of each question, so a group never grows with the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T

# Bundle sizes and the cue terms of each slot type.
BUNDLE, BUNDLE_MAX, FIRST_CATEGORY = 6, 10, 10
CUES = {
    "status": "identity relationship status career path decided transition transgender womanhood single breakup counseling mental health".split(),
    "count": "time times number count once twice three four".split(),
    "place": "where place places moved move from camp camped beach mountain mountains forest country city home park trail lake roadtrip trip".split(),
    "person": "who friend friends kid kids child children support supports".split(),
    "book": "book books read novel story title author recommended suggested".split(),
    "event": "event events participated attended joined pride parade conference poetry reading school council meeting activist group community fundraiser".split(),
    "activity": "activity activities destress hike hiking camp camping paint painting pottery swim swimming run running violin clarinet music beach family kids".split(),
    "item": "paint painted painting art pottery symbol symbols item items instrument instruments pet pets name names change changes type types bought made".split(),
    "fact": [],
}
GENERIC = "thing things something someone people person memory memories talk said tell asked shared discussed session image photo picture caption query".split()
QUESTION_TERMS = "what where when who which does did has have caroline melanie their from with some many".split()
NUMBER_WORDS = "one two three four five six seven eight once twice couple several".split()


def slot_tokens(query: Column, evidence: Column) -> Column:
    """What a note can add beyond the question's own wording."""
    return F.filter(F.array_except(T.retrieval_tokens(evidence), T.retrieval_tokens(query)), lambda t: ~t.isin(GENERIC))


def slot_score(query: Column, evidence: Column) -> Column:
    """Cue hits, target hits and typed tokens of a note for the slot that the question asks for."""
    kind = T.slot_type(query, T.PROFILE_SLOT_ORDER)
    cues = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")) for k, v in CUES.items()])
    low, tokens = F.lower(evidence), T.retrieval_tokens(evidence)
    hits = F.filter(cues, lambda c: low.contains(c) | F.array_contains(tokens, T.canonical_token(c)))
    targets = F.array_distinct(F.filter(T.ascii_tokens(query, 3), lambda t: ~t.isin(QUESTION_TERMS)))
    names = F.regexp_extract_all(evidence, F.lit(r"(?U)\b[A-Z][A-Za-z0-9']+\b"), F.lit(0))
    entities = F.array_distinct(F.transform(F.filter(names, lambda n: ~F.lower(n).isin("caroline", "melanie")), T.canonical_token))
    quotes = F.regexp_extract_all(evidence, F.lit("['\"]([^'\"]{2,80})['\"]"), F.lit(1))
    quoted = F.transform(F.filter(F.flatten(F.transform(quotes, lambda q: F.regexp_extract_all(q, F.lit("[A-Za-z0-9]+"), F.lit(0)))), lambda t: F.length(t) >= 3), T.canonical_token)
    numbers = F.filter(tokens, lambda t: t.rlike("^[0-9]+$") | t.isin(NUMBER_WORDS))
    base = slot_tokens(query, evidence)
    typed = F.when(kind.isin("book", "event", "item", "person", "place"), F.array_union(base, F.array_union(entities, quoted))).when(kind == "count", F.array_union(base, numbers)).otherwise(base)
    bonus = F.when((F.size(hits) > 0) & (F.size(entities) > 0), 1.0).otherwise(0.0)
    return 2.0 * F.size(hits) + 1.5 * T.n_common(targets, tokens) + 0.4 * F.least(F.lit(10), F.size(typed)) + bonus


def coverage_order(pool: pd.DataFrame, limit: int) -> list[int]:
    """Places of the pool's rows in rerank order: up to limit picked greedily for new slot tokens, then the rest as ranked.

    Ties go to more new tokens, the larger combined score, the earlier candidate, the smaller note_id.
    """
    rows = pool.sort_values("rank").to_dict("records")
    left, chosen = list(range(len(rows))), []
    covered: set[str] = set()
    sessions: dict[object, int] = {}
    while left and len(chosen) < limit:

        def worth(i: int) -> tuple:
            row = rows[i]
            new = set(row["slot_tokens"]) - covered
            session = row["session"] if pd.notna(row["session"]) else None
            seen = sessions.get(session, 0) if session is not None else 0
            score = row["combined"] + 0.025 * min(8, len(new)) + 0.075 * min(10.0, row["slot_score"]) + 0.025 * min(1.0, row["lexical_score"] / 8.0)
            score += (0.035 if session is not None and not seen else 0.0) - 0.025 * seen
            score -= 0.12 if row["lexical_score"] <= 0 and row["combined"] < 0.20 else 0.0
            return (-round(score, 9), -len(new), -row["combined"], row["first_seen"], row["note_id"])

        best = min(left, key=worth)
        left.remove(best)
        chosen.append(best)
        covered |= set(rows[best]["slot_tokens"])
        if pd.notna(rows[best]["session"]):
            sessions[rows[best]["session"]] = sessions.get(rows[best]["session"], 0) + 1
    return [rows[i]["rank"] for i in chosen + left]


def coverage_rerank(fused: DataFrame, k: int, limit: int = FIRST_CATEGORY) -> DataFrame:
    """query_id, note_id, position: the pool of each question in rerank order, bounded before it is grouped."""
    pool = fused.where(F.col("rank") <= max(3 * k, 3 * BUNDLE_MAX, 5 * limit))

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        ranks = coverage_order(frame, limit)
        by_rank = dict(zip(frame["rank"], frame["note_id"]))
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "note_id": [by_rank[r] for r in ranks], "position": range(1, len(ranks) + 1)})

    shape = pool.select("query_id", "note_id", F.lit(0).alias("position")).schema
    return pool.groupBy("query_id").applyInPandas(order, shape)


def pack(ranked: list[dict], neighbours: dict, category: int, k: int) -> list[tuple[object, str]]:
    """Notes of a bundle in order with their relation: primaries, and after the first two with lexical 2 or more one adjacent turn."""
    limit = FIRST_CATEGORY if category == 1 else min(k, BUNDLE)
    most = BUNDLE_MAX if category == 1 else max(limit, BUNDLE_MAX)
    out: list[tuple[object, str]] = []
    seen: set[object] = set()
    primaries = 0
    for row in ranked:
        if row["note_id"] in seen:
            continue
        seen.add(row["note_id"])
        out.append((row["note_id"], "primary"))
        primaries += 1
        if category != 1 and primaries <= 2 and row["lexical_score"] >= 2.0:
            for note_id, lexical in neighbours.get(row["note_id"], []):
                if note_id not in seen and len(seen) < most and lexical >= 1.0:
                    seen.add(note_id)
                    out.append((note_id, "local_context"))
                    break
        if primaries >= limit or len(seen) >= most:
            break
    return out


def bundles(ranked: DataFrame, neighbours: DataFrame, category: int, k: int) -> DataFrame:
    """query_id, block_pos, note_id, relation. neighbours: query_id, note_id, pos, target_id, lexical_score of
    the first two primaries' retrievable neighbours."""
    pool = ranked.where(F.col("rank") <= FIRST_CATEGORY + BUNDLE_MAX)

    def run(frame: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        beside: dict = {}
        for row in near.sort_values("pos").to_dict("records"):
            beside.setdefault(row["note_id"], []).append((row["target_id"], row["lexical_score"]))
        packed = pack(frame.sort_values("rank").to_dict("records"), beside, category, k)
        query = frame["query_id"].iloc[0] if len(frame) else None
        return pd.DataFrame({"query_id": query, "block_pos": range(1, len(packed) + 1), "note_id": [n for n, _ in packed], "relation": [r for _, r in packed]})

    first = neighbours.select(*[F.col(c).alias(c) for c in ("query_id", "note_id", "pos", "target_id", "lexical_score")])
    shape = pool.select("query_id", F.lit(0).alias("block_pos"), "note_id", F.lit("").alias("relation")).schema
    return pool.groupBy("query_id").cogroup(first.groupBy("query_id")).applyInPandas(run, shape)
