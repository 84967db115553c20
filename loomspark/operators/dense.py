"""Vectors and patterns against all rows, in blocks: matrix products in each task, never a row for a pair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.scan import Finder

#: Queries of a block, rows of one product, and rows kept beyond k where scores tie after rounding.
BLOCK, ROWS, SPARE = 2048, 1024, 8
FOUND = "query_id long, note_id long, score double"


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    block: list = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, note_id, score, rank: the k rows of largest cosine for each query row, itself left out; ties to the larger id.

    Both have note_id and embedding, and where group is given a query sees its own group only. Vectors that are null or
    of another length than most queries' (of equally frequent lengths the greater; empty ones never count) take no part; a zero vector
    has cosine 0 with all.
    """
    spark = rows.sparkSession
    sizes = queries.where("embedding IS NOT NULL AND note_id IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.agg(F.max_by("dim", F.struct("n", "dim"))).first()[0]
    if usual is None:
        return spark.createDataFrame([], "query_id long, note_id long, score double, rank int")
    dim = int(usual)
    grouped = "group" in rows.columns
    columns = ["note_id", "embedding", *(["group"] if grouped else [])]
    found: list[DataFrame] = []
    for block in _blocks(queries.where((F.size("embedding") == dim) & F.col("note_id").isNotNull()).select(*columns), BLOCK):
        matrix = _unit(pa.array([r["embedding"] for r in block], pa.list_(pa.float64())), dim)
        ids = np.array([r["note_id"] for r in block], dtype=np.int64)
        places: dict = {}
        for i, r in enumerate(block):
            places.setdefault(r["group"] if grouped else None, []).append(i)
        shipped = spark.sparkContext.broadcast((matrix, ids, {g: np.array(i) for g, i in places.items()}))  # BLOCK vectors
        good = rows.where((F.size("embedding") == dim) & F.col("note_id").isNotNull()).select(*columns)
        found.append(good.mapInArrow(_near(shipped, dim, k + SPARE, grouped), FOUND))
    scored = reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("note_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _near(shipped, dim: int, k: int, grouped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ids, places = shipped.value
        best_score, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                if not len(part):
                    continue
                note, unit = part.column(0).to_numpy(), _unit(part.column(1), dim)
                groups = np.array(part.column(2).to_pylist(), dtype=object) if grouped else None
                for group, queries in places.items():
                    mine = np.arange(len(note)) if groups is None else np.flatnonzero(groups == group)
                    if not len(mine):
                        continue
                    score = matrix[queries] @ unit[mine].T
                    score[ids[queries][:, None] == note[mine][None, :]] = -np.inf
                    both = np.concatenate([best_score[queries], score], axis=1)
                    names = np.concatenate([best_id[queries], np.broadcast_to(note[mine], score.shape)], axis=1)
                    order = np.lexsort((-names, -np.round(both, 6)), axis=1)[:, :k]
                    best_score[queries], best_id[queries] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
        query, at = np.nonzero(np.isfinite(best_score))
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(best_id[query, at]), pa.array(best_score[query, at])], names=["query_id", "note_id", "score"])

    return run


def containing(notes: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id and note_id where a note's text holds the question's word for word, also inside words.

    notes: note_id, text; questions: query_id, query. A block of questions is one automaton that reads each text once.
    """
    spark = notes.sparkSession
    shape = notes.select(F.lit(None).cast(questions.schema["query_id"].dataType).alias("query_id"), "note_id").schema
    for field in shape.fields:
        field.nullable = True
    found: list[DataFrame] = []
    for block in _blocks(questions.where("query IS NOT NULL").select("query_id", "query"), BLOCK):
        owners: dict[str, list] = {}
        for row in block:
            owners.setdefault(row["query"], []).append(row["query_id"])
        patterns = [p for p in owners if p]
        shipped = spark.sparkContext.broadcast((Finder(patterns), [owners[p] for p in patterns], owners.get("", [])))
        found.append(notes.where("text IS NOT NULL").select("note_id", "text").mapInArrow(_holds(shipped, shape), shape))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], shape)


def _holds(shipped, shape):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, owners, always = shipped.value
        for batch in batches:
            query, note = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for own in [*(q for p in find(text) for q in owners[p]), *always]:
                    query.append(own)
                    note.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(query, arrow.field(0).type), pa.array(note, arrow.field(1).type)], schema=arrow)

    return run
