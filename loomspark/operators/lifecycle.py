"""Status, reliability and the write path of notes, as column rules and one merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T

# Statuses, relations and markers.
INDEXABLE = ("active", "candidate", "stale")
PENALTY = {"active": 0.0, "candidate": 0.2, "stale": 0.4, "deprecated": 0.9, "archived": 0.8}
HISTORY = ("previous", "formerly", "old", "history", "historical", "archived")
RELATIONS = (
    "semantic_related same_topic same_entity evidence_for generalizes elaborates co_used local_context similar_event same_character temporal_anchor "
    "same_storyline same_answer_slot shared_activity shared_artifact temporal_followup before_after clarifies_answer image_text_pair local_evidence_pair supports derived_from"
).split()
FORBIDDEN = ("updates", "replaces", "conflicts_with", "update", "replace", "conflict")
UNCERTAIN = ("maybe", "might", "possibly", "probably", "not sure", "uncertain", "temporary", "temporarily", "one-time", "one time", "for this task")
SUPERSEDING = ("now", "currently", "decided", "instead", "rather than", "changed", "switch", "switched", "no longer", "replaced", "supersedes")
CONDITIONAL = ("prefer", "prefers", "preference", "likes", "wants", "interview", "essay", "academic", "when", "while", "context", "under")
MERGING = ("overwrite_existing", "refine_conditions", "append_detail")
ACTIONS = (*MERGING, "create_separate_memory", "mark_candidate_uncertain")
#: Defaults of note columns that an older table may lack.
DEFAULTS = {
    "status": "'active'", "memory_level": "'instance'", "version": "1", "confidence": "1.0D", "reliability_alpha": "1.0D", "reliability_beta": "1.0D",
    "citation_count": "0L", "successful_citation_count": "0L", "failed_citation_count": "0L", "rewrite_content": "''", "rewrite_version": "''",
    "domain_paths": "array('General')", "keywords": "CAST(array() AS array<string>)", "tags": "CAST(array() AS array<string>)",
    "evidence_memory_ids": "CAST(array() AS array<string>)", "conditions": "CAST(array() AS array<map<string,string>>)",
}


def _any(c: Column, markers) -> Column:
    return reduce(lambda a, m: a | c.contains(m), markers, F.lit(False))


def _count(c: Column, markers) -> Column:
    return reduce(lambda a, m: a + F.when(c.contains(m), 1).otherwise(0), markers, F.lit(0))


def is_indexable(status: Column) -> Column:
    return status.isin(*INDEXABLE)


def is_retrievable(status: Column, query: Column) -> Column:
    """Indexable notes always; deprecated and archived ones for questions about the past."""
    return is_indexable(status) | (status.isin("deprecated", "archived") & _any(F.lower(query), HISTORY))


def penalty(status: Column) -> Column:
    return reduce(lambda rest, s: F.when(status == s, PENALTY[s]).otherwise(rest), PENALTY, F.lit(0.0))


def reliability(success: Column, failure: Column, alpha: Column, beta: Column) -> Column:
    return (success + alpha) / F.greatest(success + failure + alpha + beta, F.lit(1e-6))


def citation_score(citations: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(citations.cast("double")) / 5.0)


def one_of(c: Column, allowed, default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(default)


def edge_relation(relation: Column) -> Column:
    """Forbidden relations become none, unknown ones semantic_related."""
    low = F.lower(F.coalesce(relation, F.lit("semantic_related")))
    return F.when(low.isin(*FORBIDDEN), "none").when(low.isin(*RELATIONS), low).otherwise("semantic_related")


def backfill(notes: DataFrame) -> DataFrame:
    """Columns that an older table lacks, or holds as nulls, with their defaults."""
    have = set(notes.columns)
    return notes.withColumns({c: F.coalesce(F.col(c), F.expr(d)) if c in have else F.expr(d) for c, d in DEFAULTS.items()})


def decide(content: Column, target_content: Column, overlap: Column) -> Column:
    """Action, relation and confidence for a new note against its best candidate; a null overlap means no candidate."""
    low, best = F.lower(content), F.coalesce(overlap, F.lit(-1.0))
    both = F.lower(F.concat_ws(" ", target_content, content))
    out = lambda a, r, c: F.struct(F.lit(a).alias("action"), F.lit(r).alias("relation"), F.lit(c).alias("confidence"))
    return (
        F.when(_any(low, UNCERTAIN), out("mark_candidate_uncertain", "semantic_related", 0.4))
        .when(best < 0.08, out("create_separate_memory", "semantic_related", 0.6))
        .when(_any(low, SUPERSEDING) & (best >= 0.16), out("overwrite_existing", "same_entity", 0.75))
        .when(_count(both, CONDITIONAL) >= 2, out("refine_conditions", "same_topic", 0.7))
        .when(best >= 0.16, out("append_detail", "elaborates", 0.65))
        .otherwise(out("create_separate_memory", "semantic_related", 0.6))
    )


def normalize_decision(action: Column, target: Column, relation: Column, confidence: Column, candidates: Column) -> Column:
    """A model's decision with everything out of range replaced."""
    known = one_of(action, ACTIONS, "create_separate_memory")
    valid = F.when(F.array_contains(candidates, target), target).otherwise(F.try_element_at(candidates, F.lit(1)))
    final = F.when(known.isin(*MERGING), F.when(valid.isNull(), "create_separate_memory").otherwise(known)).otherwise(known)
    kept = F.when(relation == "none", "none").otherwise(one_of(relation, RELATIONS, "semantic_related"))
    return F.struct(final.alias("action"), F.when(known.isin(*MERGING), valid).otherwise(target).alias("target"), kept.alias("relation"), T.clamp_confidence(confidence, 0.6).alias("confidence"))


def merged_content(mode: Column, old: Column, new: Column) -> Column:
    return (
        F.when(mode == "overwrite_existing", new)
        .when(mode == "refine_conditions", F.concat(old, F.lit(" Also, under a different condition or context, "), new))
        .when(old.contains(new), old)
        .otherwise(F.concat(old, F.lit(" "), new))
    )


def merge_unique(left: Column, right: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(left, right), lambda x: x.isNotNull() & (x != "")))


def merged_conditions(mode: Column, old: Column, new: Column, context: Column, content: Column) -> Column:
    base = F.when(mode == "overwrite_existing", F.array().cast("array<map<string,string>>")).otherwise(old)
    made = F.array(F.create_map(F.lit("context"), context, F.lit("detail"), content))
    add = (F.size(new) == 0) & mode.isin("refine_conditions", "overwrite_existing")
    return F.when(add, F.concat(base, new, made)).otherwise(F.concat(base, new))


def revision_rows(history: Column, version: Column, old: Column, new: Column, stamp: Column, last_updated: Column, reason: Column, source: Column) -> Column:
    """The history with a snapshot of the old content where it is not the last entry, and the new version."""
    entry = lambda v, c, r, s, t: F.struct(v.alias("version"), c.alias("content"), r.alias("update_reason"), s.alias("source_memory_id"), t.alias("timestamp"))
    nobody = F.lit(None).cast("string")
    first = entry(version, old, F.lit("Initial memory before write-time consolidation."), nobody, stamp)
    again = entry(version, old, F.lit("Snapshot before write-time consolidation."), nobody, last_updated)
    last = entry(version + 1, new, reason, source, last_updated)
    stale = F.coalesce(F.try_element_at(history, F.lit(-1))["content"] != old, F.lit(True))
    return F.when(F.size(history) == 0, F.array(first, last)).when(stale, F.concat(history, F.array(again, last))).otherwise(F.concat(history, F.array(last)))


def upsert(notes: DataFrame, changes: DataFrame, key: str = "memory_id") -> DataFrame:
    """A merge into the notes table: a change replaces the note of its key, a new key is added. One shuffle on the key."""
    order = notes.columns
    both = notes.withColumn("_p", F.lit(0)).unionByName(changes.select(*order).withColumn("_p", F.lit(1)))
    newest = both.groupBy(key).agg(F.max_by(F.struct(*order), "_p").alias("row"))
    return newest.select("row.*")
