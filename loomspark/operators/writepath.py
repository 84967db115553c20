"""The write path: a batch of new notes against the notes that are there, as one merge.

Every new note of a batch is compared with the table before the batch; of several that
rewrite the same note the later ones continue on what the earlier ones made, in order of
arrival. Samples are independent. Where each note has to see all notes that arrived before
it, ``streaming.arrivals`` keeps a sample's notes as state.

notes and new: sample_id, note_id, ord, content, tokens (set), status, version, confidence,
memory_level (null: instance), and, where they have them, context, keywords, tags,
domain_paths, conditions (merged into a rewritten note) and provided (an instance whose
domains were given is stored without edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators import lifecycle, overlap

CANDIDATES, EDGES = 10, 5
#: What a rewritten note's history holds.
REVISION = "array<struct<version:int,content:string,update_reason:string,source_memory_id:string>>"


def candidates(notes: DataFrame, new: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """sample_id, new_id, note_id, place, overlap: the k notes of the sample that share most with each new note, by Jaccard, then age."""
    held = notes.where(lifecycle.is_indexable(F.col("status"))).select("sample_id", "note_id", "ord", "tokens")
    asked = new.select("sample_id", F.col("note_id").alias("ask_id"), "ord", "tokens")
    return overlap.nearest(asked, held, k).select("sample_id", F.col("ask_id").alias("new_id"), "note_id", "place", "overlap")


def decisions(notes: DataFrame, new: DataFrame, found: DataFrame) -> DataFrame:
    """sample_id, new_id, ord, content, target_id, overlap, action, relation, confidence of each new note by the rules.

    A model's decisions (parsers.relation) can take their place: normalise them and go on with apply().
    """
    best = found.where("place = 1").select("sample_id", "new_id", F.col("note_id").alias("target_id"), "overlap")
    old = notes.select("sample_id", F.col("note_id").alias("target_id"), F.col("content").alias("target_content"))
    rows = new.select("sample_id", F.col("note_id").alias("new_id"), "ord", "content").join(best, ["sample_id", "new_id"], "left").join(old, ["sample_id", "target_id"], "left")
    rule = lifecycle.decide(F.col("content"), F.col("target_content"), F.col("overlap"))
    alone = F.struct(F.lit("create_separate_memory").alias("action"), F.lit("semantic_related").alias("relation"), F.lit(0.6).alias("confidence"))
    made = rows.withColumn("d", F.when(F.col("target_id").isNull(), alone).otherwise(rule))
    return made.select("sample_id", "new_id", "ord", "content", "target_id", "overlap", "d.action", "d.relation", "d.confidence")


def apply(notes: DataFrame, new: DataFrame, decided: DataFrame) -> DataFrame:
    """The notes after the batch: rewritten targets, new notes (uncertain ones as candidates), and the others as they were.

    Adds history (REVISION) and evidence_ids. One shuffle by target; a target's rewrites are folded in order of arrival: the content by
    the action's rule, keywords, tags and domains joined without repeats, conditions by lifecycle.merged_conditions, the newest context.
    """
    lists = [c for c in ("keywords", "tags", "domain_paths") if c in notes.columns]
    conditions, context = "conditions" in notes.columns, "context" in notes.columns
    carried = [*lists, *(["conditions"] if conditions else []), *(["context"] if context else [])]
    merging = decided.where(F.col("action").isin(*lifecycle.MERGING)).select("sample_id", "new_id", "target_id", "action", F.col("confidence").cast("double").alias("confidence"))
    told = merging.join(new.select("sample_id", F.col("note_id").alias("new_id"), "ord", "content", *carried), ["sample_id", "new_id"])
    step = F.struct("ord", F.struct("new_id", "action", "content", "confidence", *carried).alias("x"))
    # conditions are maps, which have no order, so the steps are sorted by arrival and id alone
    todo = told.groupBy("sample_id", F.col("target_id").alias("note_id")).agg(F.collect_list(step).alias("todo"))
    before = lambda a, b: F.when(F.struct(a["ord"], a["x"]["new_id"]) < F.struct(b["ord"], b["x"]["new_id"]), -1).otherwise(1)
    todo = todo.withColumn("todo", F.transform(F.array_sort("todo", before), lambda s: s["x"]))
    rows = notes.join(todo, ["sample_id", "note_id"], "left")
    entry = lambda v, c, r, s: F.struct(v.cast("int").alias("version"), c.alias("content"), r.alias("update_reason"), s.cast("string").alias("source_memory_id"))
    first = entry(F.col("version"), F.col("content"), F.lit("Initial memory before write-time consolidation."), F.lit(None))
    kept_as = {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists}
    if conditions:
        kept_as["conditions"] = F.coalesce("conditions", F.array().cast(notes.schema["conditions"].dataType))
    if context:
        kept_as["context"] = F.coalesce("context", F.lit(""))
    state = F.struct(
        F.col("content").alias("content"), F.col("version").cast("int").alias("version"), F.col("confidence").cast("double").alias("confidence"), F.array(first).cast(REVISION).alias("history"), *[v.alias(c) for c, v in kept_as.items()],
    )

    def fold(s, x):
        content = lifecycle.merged_content(x["action"], s["content"], x["content"])
        reason = F.concat(F.lit("Write-time consolidation via "), x["action"], F.lit("."))
        out = [
            content.alias("content"), (s["version"] + 1).alias("version"), F.least(F.lit(1.0), F.greatest(s["confidence"], x["confidence"])).alias("confidence"),
            F.concat(s["history"], F.array(entry(s["version"] + 1, content, reason, x["new_id"])).cast(REVISION)).alias("history"),
            *[lifecycle.merge_unique(s[c], F.coalesce(x[c], F.array().cast("array<string>"))).alias(c) for c in lists],
        ]
        if conditions:
            given = F.coalesce(x["conditions"], F.array().cast(notes.schema["conditions"].dataType))
            out.append(lifecycle.merged_conditions(x["action"], s["conditions"], given, F.coalesce(x["context"], F.lit("")) if context else F.lit(""), x["content"]).alias("conditions"))
        if context:
            out.append(F.when(F.coalesce(x["context"], F.lit("")) != "", x["context"]).otherwise(s["context"]).alias("context"))
        return F.struct(*out)

    done = rows.withColumn("s", F.when(F.col("todo").isNotNull(), F.aggregate("todo", state, fold)))
    own = [c for c in notes.columns if c not in ("content", "version", "confidence", "status", *carried)]
    none = F.array().cast(REVISION)
    ids = F.coalesce(F.transform("todo", lambda x: x["new_id"].cast("string")), F.array().cast("array<string>"))
    changed = F.col("s").isNotNull()
    kept = done.select(
        *own, F.coalesce("s.content", "content").alias("content"), F.coalesce(F.col("s.version"), F.col("version").cast("int")).alias("version"), F.coalesce(F.col("s.confidence"), F.col("confidence").cast("double")).alias("confidence"),
        F.when(changed, "active").otherwise(F.col("status")).alias("status"), *[F.when(changed, F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in carried], F.coalesce("s.history", none).alias("history"), ids.alias("evidence_ids"),
    )
    apart = decided.where(~F.col("action").isin(*lifecycle.MERGING)).select("sample_id", F.col("new_id").alias("note_id"), "action", F.col("confidence").alias("_c"))
    added = new.join(apart, ["sample_id", "note_id"])
    unsure = F.col("action") == "mark_candidate_uncertain"
    added = added.select(
        *own, "content", F.col("version").cast("int").alias("version"), F.when(unsure, F.least(F.col("confidence").cast("double"), F.lit(0.4))).otherwise(F.col("confidence").cast("double")).alias("confidence"),
        F.when(unsure, "candidate").otherwise(F.col("status")).alias("status"), *carried, none.alias("history"), F.array().cast("array<string>").alias("evidence_ids"),
    )
    return kept.unionByName(added)


def stable_edges(decided: DataFrame, found: DataFrame) -> DataFrame:
    """sample_id, src_id, target_id, relation, strength: edges of each written note to its first candidates, back too for symmetric relations.

    A rewritten note is the source in place of the new one, and has no edge to itself.
    """
    kept = F.when(F.col("relation").isin(*lifecycle.FORBIDDEN, "none") | ~F.col("relation").isin(*lifecycle.RELATIONS), "semantic_related").otherwise(F.col("relation"))
    source = F.when(F.col("action").isin(*lifecycle.MERGING), F.col("target_id")).otherwise(F.col("new_id"))
    written = decided.select("sample_id", "new_id", source.alias("src_id"), kept.alias("relation"), F.col("confidence").alias("strength"))
    near = found.join(written, ["sample_id", "new_id"]).where(F.col("note_id") != F.col("src_id"))
    place = F.row_number().over(Window.partitionBy("sample_id", "new_id").orderBy("place"))
    near = near.withColumn("p", place).where(F.col("p") <= EDGES)
    forth = F.struct(F.col("src_id").alias("s"), F.col("note_id").alias("t"))
    back = F.when(F.col("relation").isin("semantic_related", "same_topic", "same_entity", "co_used"), F.struct(F.col("note_id").alias("s"), F.col("src_id").alias("t")))
    both = near.select("sample_id", "relation", "strength", F.explode(F.array_compact(F.array(forth, back))).alias("e"))
    return both.groupBy("sample_id", F.col("e.s").alias("src_id"), F.col("e.t").alias("target_id"), "relation").agg(F.max("strength").alias("strength"))


def evolved(decided: DataFrame, before: int, threshold: int = 100) -> tuple[int, bool]:
    """Evolutions counted on after the batch, and whether the whole index is due to be rebuilt: where the count passes a multiple of the threshold."""
    now = before + decided.where("evolves").count()
    return now, now // threshold > before // threshold


def write(notes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes after the batch, their new edges, and the decisions, each with evolves: whether it counts towards a rebuild.

    Notes of level instance, which is the default, are kept apart and only linked; of those whose domains were provided not even that. A linked
    instance counts as an evolution where provided says that its domains were not given.
    """
    instance = F.coalesce(F.lower("memory_level"), F.lit("instance")) == "instance"
    whole = new.where(instance)
    silent = F.coalesce("provided", F.lit(False)) & instance if "provided" in new.columns else F.lit(False)
    found = candidates(notes, new.where(~silent))
    ruled = decisions(notes, new.where(~instance), found).withColumn("evolves", F.col("action").isin(*lifecycle.MERGING, "mark_candidate_uncertain"))
    some = found.select("sample_id", "new_id").distinct().withColumn("evolves", F.lit("provided" in new.columns))
    apart = whole.select("sample_id", F.col("note_id").alias("new_id"), "ord", "content", F.lit(None).cast(notes.schema["note_id"].dataType).alias("target_id"), F.lit(None).cast("double").alias("overlap"),
                         F.lit("create_separate_memory").alias("action"), F.lit("semantic_related").alias("relation"), F.lit(0.6).alias("confidence"))
    apart = apart.join(some, ["sample_id", "new_id"], "left").withColumn("evolves", F.coalesce("evolves", F.lit(False)))
    decided = ruled.unionByName(apart)
    return apply(notes, new, decided), stable_edges(decided, found), decided
