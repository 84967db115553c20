"""Persisted stages of the memory: vectors, indexes and the domain graph, each with its layout version.

Where a stage is missing or of another version the caller builds it anew.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import graph, lifecycle, parsers
from loomspark.sources import dialogue, scratch

# Relations that the offline graph holds, and those that older graphs held.
OFFLINE = ["similar_event", "same_character", "same_storyline", "image_text_pair"]
LEGACY = ["temporal_anchor", "same_answer_slot", "shared_activity", "shared_artifact", "temporal_followup", "before_after", "clarifies_answer", "local_evidence_pair", "supports", "derived_from"]


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors and the texts they stand for, by sample."""
    dialogue.write_table(vectors, path, "sample_id")


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    return dialogue.read_table(spark, path)


def index_rows(notes: DataFrame) -> DataFrame:
    """The index of all indexable notes: sample_id, note_id, ord, index_text and its tokens; a rebuild is this again.

    notes: sample_id, note_id, ord, status, rewrite, dia_id, session_date, speaker, keywords, tags, image_caption, image_query.
    """
    text = T.index_text(*[F.col(c) for c in ("rewrite", "dia_id", "session_date", "speaker", "keywords", "tags", "status", "image_caption", "image_query")])
    made = notes.where(lifecycle.is_indexable(F.col("status"))).select("sample_id", "note_id", "ord", text.alias("index_text"))
    return made.withColumn("tokens", T.retrieval_tokens(F.col("index_text")))


def append(index: DataFrame, notes: DataFrame) -> DataFrame:
    """The index with new notes' rows; a note that is there already stays as it was until the next rebuild."""
    fresh = index_rows(notes).join(index.select("sample_id", "note_id"), ["sample_id", "note_id"], "left_anti")
    return index.unionByName(fresh)


def clear_edges(edges: DataFrame) -> DataFrame:
    """Edges but those of offline graphs, of this layout or older ones."""
    return edges.where(~F.col("relation").isin(*OFFLINE, *LEGACY))


def graph_cache(notes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is kept of a sample's graph: annotations (sample_id, dia_id, domain_paths, temporal) and offline edges by turn ids, note ids where there is none.

    notes: sample_id, note_id, dia_id, domain_paths, content.
    """
    key = F.coalesce("dia_id", F.col("note_id").cast("string"))
    annotations = notes.select("sample_id", key.alias("dia_id"), "domain_paths", T.temporal_markers(F.col("content")).alias("temporal"))
    names = notes.select("sample_id", "note_id", key.alias("key"))
    kept = edges.where(F.col("relation").isin(*OFFLINE))
    source = kept.join(names.select("sample_id", F.col("note_id").alias("src_id"), F.col("key").alias("src_dia")), ["sample_id", "src_id"])
    both = source.join(names.select("sample_id", F.col("note_id").alias("target_id"), F.col("key").alias("target_dia")), ["sample_id", "target_id"], "left")
    return annotations, both.select("sample_id", "src_dia", "target_dia", "target_id", "relation", "strength")


def save_graph(notes: DataFrame, edges: DataFrame, path: str) -> None:
    annotations, kept = graph_cache(notes, edges)
    dialogue.write_table(annotations, f"{path}/annotations", "sample_id")
    dialogue.write_table(kept, f"{path}/edges", "sample_id")


def load_graph(spark: SparkSession, path: str, notes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Notes and edges with a kept graph applied, or None where there is none of this version."""
    annotations, kept = dialogue.read_table(spark, f"{path}/annotations"), dialogue.read_table(spark, f"{path}/edges")
    return None if annotations is None or kept is None else apply_graph(notes, edges, annotations, kept)


def prepare_graph(spark: SparkSession, path: str, notes: DataFrame, edges: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Notes and edges with each sample's offline graph: kept ones are loaded, stale samples are built and saved, in one call.

    build takes the notes of the stale samples and gives notes with domain_paths and offline edges (as graph_cache takes them); it runs
    once for all of them. A sample is stale if its annotations are missing or of another version.
    """
    due = scratch.materialise(notes.select("sample_id").distinct() if force else dialogue.stale(spark, f"{path}/annotations", notes, "sample_id"), "stale")
    if not due.isEmpty():
        annotations, kept = graph_cache(*build(notes.join(due, "sample_id", "left_semi")))
        # edges first: a sample counts as built once its annotations are there. A sample without edges keeps no older ones
        none = due.select("sample_id", *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns if c != "sample_id"])
        dialogue.write_partitions(kept.unionByName(none), f"{path}/edges", "sample_id")
        dialogue.write_partitions(annotations, f"{path}/annotations", "sample_id")
    kind = notes.schema["sample_id"].dataType
    read = lambda name: spark.read.parquet(f"{path}/{name}").drop("_version").withColumn("sample_id", F.col("sample_id").cast(kind))
    return apply_graph(notes, edges, read("annotations"), read("edges").where("relation IS NOT NULL"))


def apply_graph(notes: DataFrame, edges: DataFrame, annotations: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept paths (three at most, normalised) for the notes that have some, and kept edges in place of offline ones.

    Targets are found by turn id, else by note id; relations that offline graphs don't hold, and edges to nowhere, go.
    """
    key = F.coalesce("dia_id", F.col("note_id").cast("string"))
    told = annotations.select("sample_id", F.col("dia_id").alias("_key"), F.transform(F.slice("domain_paths", 1, 3), T.normalize_domain).alias("_paths"))
    placed = notes.withColumn("_key", key).join(told, ["sample_id", "_key"], "left")
    placed = placed.withColumn("domain_paths", F.when(F.size("_paths") > 0, F.col("_paths")).otherwise(F.col("domain_paths"))).drop("_key", "_paths")
    names = notes.select("sample_id", "note_id", key.alias("key"))
    own = F.col("relation").isin(*OFFLINE)
    rows = kept.where(own).join(names.select("sample_id", F.col("key").alias("src_dia"), F.col("note_id").alias("src_id")), ["sample_id", "src_dia"])
    by_dia = names.select("sample_id", F.col("key").alias("target_dia"), F.col("note_id").alias("by_dia"))
    by_id = names.select("sample_id", F.col("note_id").alias("target_id"), F.col("note_id").alias("by_id"))
    found = rows.join(by_dia, ["sample_id", "target_dia"], "left").join(by_id, ["sample_id", "target_id"], "left").withColumn("target", F.coalesce("by_dia", "by_id"))
    applied = found.where("target IS NOT NULL").select("sample_id", "src_id", F.col("target").alias("target_id"), "relation", "strength")
    return placed, graph.upsert_edges(clear_edges(edges).select(*applied.columns).unionByName(applied))


def log_to(path: str, level: int = logging.INFO) -> logging.Logger:
    """The driver's log, to the console and a file; executors log through Spark."""
    logger = logging.getLogger("loomspark")
    logger.setLevel(level)
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
        handler.close()
    shape = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    for handler in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
        handler.setFormatter(shape)
        logger.addHandler(handler)
    return logger


def empty_or(response: str | None, schema: str) -> str:
    """A connector's response, or the empty object of its schema where the call failed."""
    return response if response else parsers.typed_empty(schema)
