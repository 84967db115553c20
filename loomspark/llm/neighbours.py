"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

1. Equal vectors are one entry of the index, with the few smallest ids that can ever be
   among a query's nearest; so a vector that a third of all rows share costs one entry.
2. A bounded sample trains coarse centroids and, on what remains after taking the nearest
   centroid away, codebooks of 16 subspaces. Every entry is indexed: cell, codes, vector.
3. Cells that lie near each other form a shelf of about CHUNK entries, and a shelf's entries
   lie in chunks of bounded size, so a crowded cell is split over tasks. A query visits the
   cells nearest to it; how many, is read off the exact neighbours of a sample, for without
   clusters neighbours lie in cells far apart; further ones, where those hold too few ids. It is sent to each shelf once, with the cells
   it visits there. In a chunk, tables of query-to-codeword products give the distance of the
   query to what the codes of those cells stand for; the best are scored exactly on the original
   vectors, in double precision. So is every other entry that may be as near: each entry knows how
   far it lies from what its codes stand for, and is left out only if the triangle inequality rules
   it out. Within the visited cells nothing is lost, however crowded they are and however coarse
   the codes. Only a query's few best leave the chunk.

All vectors are scaled to length 1 for the index, so the nearest by distance is the nearest
by cosine. The reported score is the cosine of the original vectors.

Defined results: vectors that are null, all zero, or hold null or non-finite components take
no part, as queries or candidates, and neither do vectors of a length other than the most
frequent (ties to the smaller), for which no cosine exists, nor rows without an id; repeated
rows of one id are that id once, with each of its different vectors a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most so many different vectors train the index: those of smallest hash.
SAMPLE_ROWS = 20_000
SUBSPACES, CODEWORDS = 16, 256
#: Cells for each root of the number of entries, and training vectors that a cell needs.
CELLS_BY_ROOT, PER_CENTROID = 2.0, 5
#: Share of the sample's exact neighbours whose cells must be visited. At most so many queries ask for
#: them, among so many vectors that haven't trained the index (among all, where they are few).
REACH, REACH_QUERIES, REACH_ROWS = 0.97, 1000, 10_000
#: Entries of a chunk, and candidates of a chunk that are scored exactly first for one query; they tell which others must be.
CHUNK, RERANK = 16_384, 384
#: What rounding may do to a squared distance or cosine of vectors of length 1.
SLACK = 1e-12
#: Queries that one task scores against a chunk.
QUERY_BLOCK = 8192


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding of the rows that take part (and _asked, where there is one)."""
    good = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"  # half the bytes to move; the measure is double all the same
    values = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    more = [c for c in vectors.columns if c == "_asked"]
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("e"), *more).where(F.col("vec_id").isNotNull() & good)
    lengths = rows.groupBy(F.size("e").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).select("length")
    return rows.join(F.broadcast(lengths), F.size("e") == F.col("length")).select("vec_id", F.col("e").alias("embedding"), *more)  # one row


class Index:
    """Coarse centroids and codebooks; of fixed size, whatever the corpus."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        unit = normalised(sample)
        self.centroids = kmeans(unit, cells, rng)
        residual = unit - self.centroids[nearest(unit, self.centroids)]
        dim = unit.shape[1]
        self.shelf = np.zeros(len(self.centroids), dtype=np.int64)
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], CODEWORDS, rng, rounds=8) for a, b in zip(self.cuts, self.cuts[1:])]

    def shelve(self, shelves: int) -> None:
        """Put neighbouring cells on one shelf."""
        self.shelf = nearest(self.centroids, kmeans(self.centroids, shelves, np.random.default_rng(3)))

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each vector."""
        cell = nearest(unit, self.centroids)
        residual = unit - self.centroids[cell]
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1)
        return cell, codes.astype(np.uint8)

    def probes(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The cells nearest to each query."""
        n = min(n, len(self.centroids))
        product = 2 * unit @ self.centroids.T - (self.centroids**2).sum(axis=1)
        return np.argpartition(-product, n - 1, axis=1)[:, :n]

    def enough(self, unit: np.ndarray, n: int, ids: np.ndarray, least: int) -> list[np.ndarray]:
        """The n cells nearest to each query, and for queries whose cells hold fewer than least ids, further ones; ids: how many each cell holds."""
        cells = list(self.probes(unit, n))
        for k, near in enumerate(cells):
            if ids[near].sum() < least:
                order = np.argsort((self.centroids**2).sum(axis=1) - 2 * self.centroids @ unit[k], kind="stable")
                cells[k] = order[: max(n, int(np.searchsorted(np.cumsum(ids[order]), least)) + 1)]
        return cells

    def reach(self, queries: np.ndarray, entries: np.ndarray, top: int, asked: np.ndarray | None = None, owners: np.ndarray | None = None) -> int:
        """How many cells a query must visit to meet REACH of its nearest entries; an equal vector is left out.

        With asked and owners, the ids of queries and entries, an id counts by the nearest of its entries, and the query's not at all.
        """
        cell, visits = nearest(entries, self.centroids), []
        several = owners is not None and len(np.unique(owners)) < len(owners)
        place_of = {x.tobytes(): i for i, x in enumerate(entries)}
        for a in range(0, len(queries), 64):
            block = queries[a : a + 64]
            product = block @ entries.T
            own = [(i, place_of[x.tobytes()]) for i, x in enumerate(block) if x.tobytes() in place_of]
            if own:
                product[tuple(np.array(own).T)] = -np.inf
            if several:
                product[asked[a : a + 64, None] == owners[None]] = -np.inf
            order = np.argsort(-product, axis=1)
            if several:  # the first of each id
                order = np.stack([o[np.sort(np.unique(owners[o], return_index=True)[1])] for o in order])
            best = order[:, :top]
            near = 2 * block @ self.centroids.T - (self.centroids**2).sum(axis=1)
            place = np.argsort(np.argsort(-near, axis=1), axis=1)
            found = np.take_along_axis(place, cell[best], axis=1)
            visits.append(found[np.isfinite(np.take_along_axis(product, best, axis=1))])
        visits = np.sort(np.concatenate(visits)) if visits else np.zeros(0, np.int64)
        return int(visits[math.ceil(REACH * len(visits)) - 1]) + 1 if len(visits) else 1

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a query needs to score codes: its product with each centroid, and with each codeword of each subspace."""
        words = np.stack([np.pad(book @ query[a:b], (0, CODEWORDS - len(book))) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)])
        return self.centroids @ query, words.ravel()

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        return self.centroids[cell] + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)


def normalised(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # components of any size survive the square
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    norm = (centres**2).sum(axis=1)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (norm - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], axis=1)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The exact measure: double-precision cosine of original vectors."""
    q, r = query / np.abs(query).max(), rows / np.abs(rows).max(axis=1, keepdims=True)
    return (r * q).sum(axis=1) / (np.sqrt((r * r).sum(axis=1)) * np.sqrt(q @ q))  # equal rows get equal sums, wherever they stand


FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, top: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The top nearest of every query row among all other rows: query_id, rank, vec_id, score."""
    from loomspark.llm.shared import discard, materialise

    spark = vectors.sparkSession
    rows = usable(vectors.withColumn("_asked", F.coalesce(is_query, F.lit(False))), vec_id, embedding)
    # a query never needs more than top + 1 ids of one vector: its own may be among them. The limit
    # holds in each task before the shuffle, so a vector of very many rows stays small.
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = rows.select("vec_id", "embedding").distinct().withColumn("_n", order).where(F.col("_n") <= top + 1)
    entries = materialise(first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "neighbour-entries")
    count = entries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return empty
    cells = max(1, min(SAMPLE_ROWS // PER_CENTROID, round(CELLS_BY_ROOT * math.sqrt(count))))
    sample, owners = _sample(entries.select("embedding", F.xxhash64("embedding").alias("h"), F.col("ids")[0].alias("id")), SAMPLE_ROWS + REACH_ROWS)
    built = Index(sample[:SAMPLE_ROWS], cells)
    built.shelve(min(cells, -(-count // CHUNK)))
    queries = rows.where("_asked").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked, names = _sample(queries.select("embedding", F.xxhash64(F.lit(1), "embedding").alias("h"), F.col("query_id").alias("id")), REACH_QUERIES)
    if not len(asked):
        return empty
    known = slice(SAMPLE_ROWS if count > SAMPLE_ROWS + REACH_ROWS else 0, None)
    probes = built.reach(normalised(asked), normalised(sample[known]), top, names, owners[known])
    index = spark.sparkContext.broadcast(built)
    element = entries.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                cell, codes = index.value.assign(normalised(_matrix(part.column(0))))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(index.value.shelf[cell].astype(np.int32)), pa.array(cell.astype(np.int32)), packed, part.column(0), part.column(1)], names=["shelf", "cell", "codes", "embedding", "ids"])

    indexed = materialise(entries.mapInArrow(place, f"shelf int, cell int, codes binary, embedding {element}, ids array<long>"), "neighbour-index")
    discard(entries)
    # one row for each cell: how many ids it holds, each counted in one cell only, so that cells add up
    homes = indexed.select(F.explode("ids").alias("id"), "cell").groupBy("id").agg(F.min("cell").alias("cell")).groupBy("cell").count().collect()
    held_ids = np.zeros(len(built.centroids), dtype=np.int64)
    for home in homes:
        held_ids[home["cell"]] = home["count"]
    # one row for each shelf, of which there are no more than cells: how many chunks its entries fill
    chunks = indexed.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    chunked = indexed.join(F.broadcast(chunks), "shelf").select("shelf", F.pmod(F.xxhash64("embedding"), F.col("chunks")).alias("chunk"), "cell", "codes", "embedding", "ids")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                if not len(part):
                    continue
                cells = index.value.enough(normalised(_matrix(part.column(1))), probes, held_ids, top + 1)  # the query's own id may be among them
                owner, near = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells)
                order = np.lexsort((index.value.shelf[near], owner))
                owner, near, shelf = owner[order], near[order], index.value.shelf[near[order]]
                begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (shelf[1:] != shelf[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, near.size).astype(np.int32)), pa.array(near.astype(np.int32)))
                who = pa.array(owner[begin])
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), pa.array(shelf[begin].astype(np.int32)), lists, part.column(1).take(who)], names=["query_id", "shelf", "cells", "embedding"])

    visits = materialise(queries.mapInArrow(visit, f"query_id long, shelf int, cells array<int>, embedding {element}"), "neighbour-visits")
    # a crowd of queries is dealt out in blocks as the entries are in chunks; again one row for each shelf
    blocks = visits.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    dealt = visits.join(F.broadcast(chunks), "shelf").join(F.broadcast(blocks), "shelf")
    dealt = dealt.select("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), "query_id", "cells", "embedding")
    held = chunked.join(F.broadcast(blocks), "shelf")
    held = held.select("shelf", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "cell", "codes", "embedding", "ids")

    def scan(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if len(asked) and len(held):
            chunk, names, cells = _Chunk(held, index.value), asked.column("query_id").to_pylist(), asked.column("cells").combine_chunks()
            flat, ends = cells.flatten().to_numpy(), np.cumsum(np.append(0, cells.value_lengths().to_numpy()))
            for k, query in enumerate(_matrix(asked.column("embedding"))):
                found += chunk.best(index.value, names[k], query, flat[ends[k] : ends[k + 1]], top)
        ids, near, score = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    key = ["shelf", "chunk", "block"]
    found = dealt.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(scan, FOUND)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may have several vectors
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


class _Chunk:
    """A chunk's entries in order of their cells."""

    def __init__(self, held: pa.Table, index: Index):
        cell = held.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), dtype=np.uint8).reshape(len(cell), -1)[order]
        self.cell = cell[order]
        self.names, self.start = np.unique(self.cell, return_index=True)
        self.end = np.append(self.start[1:], len(cell))
        self.codes = codes.astype(np.int32) + CODEWORDS * np.arange(codes.shape[1], dtype=np.int32)
        self.vectors = _matrix(held.column("embedding").combine_chunks())[order]
        self.scale, self.size, self.off = np.empty(len(cell)), np.empty(len(cell)), np.empty(len(cell))
        for a in range(0, len(cell), 1024):
            part = slice(a, a + 1024)
            self.vectors[part] /= np.abs(self.vectors[part]).max(axis=1, keepdims=True)  # components of any size survive the square
            self.scale[part] = np.sqrt((self.vectors[part] ** 2).sum(axis=1))
            stands = index.decoded(self.cell[part], codes[part])
            self.size[part] = (stands**2).sum(axis=1)
            self.off[part] = np.sqrt(((self.vectors[part] / self.scale[part, None] - stands) ** 2).sum(axis=1))
        ids = held.column("ids").to_pylist()
        self.ids = [ids[k] for k in order]

    def best(self, index: Index, name: int, query: np.ndarray, cells: np.ndarray, top: int) -> list[tuple[int, int, float]]:
        """The nearest ids of the visited cells: the best by their codes are scored first, then all that may be as near."""
        at = np.searchsorted(self.names, cells)
        here = at[(at < len(self.names))]
        here = here[np.isin(self.names[here], cells)]
        if not len(here):
            return []
        entries = np.concatenate([np.arange(self.start[k], self.end[k]) for k in np.unique(here)])
        unit = normalised(query[None])[0]
        near, words = index.tables(unit)
        estimate = near[self.cell[entries]] + words[self.codes[entries]].sum(axis=1)
        far = np.sqrt(np.maximum(1 + self.size[entries] - 2 * estimate - SLACK, 0))
        first = np.argpartition(far, min(RERANK, len(entries)) - 1)[:RERANK]
        score = np.full(len(entries), -np.inf)
        score[first] = self._score(unit, entries[first])
        least = self._least(name, entries[first], score[first], top)
        rest = far <= np.sqrt(max(2 - 2 * least, 0) + SLACK) + self.off[entries]
        rest[first] = False
        rest = np.flatnonzero(rest)
        if len(rest):
            score[rest] = self._score(unit, entries[rest])
            least = self._least(name, entries, score, top)
        chosen = entries[score >= max(least, -2) - SLACK]
        kept: dict[int, float] = {}
        for s, v in sorted((-s, v) for s, e in zip(cosines(query, self.vectors[chosen]).tolist(), chosen) for v in self.ids[e] if v != name):
            kept.setdefault(v, -s)  # an id may have several vectors
            if len(kept) == top:
                break
        return [(name, v, s) for v, s in kept.items()]

    def _score(self, unit: np.ndarray, entries: np.ndarray) -> np.ndarray:
        few = 4 * len(entries) < len(self.vectors)
        product = self.vectors[entries] @ unit if few else (self.vectors @ unit)[entries]
        return product / self.scale[entries]

    def _least(self, name: int, entries: np.ndarray, score: np.ndarray, top: int) -> float:
        """The score that the top-th id other than the query's reaches; without so many ids, none is too small."""
        ids: set[int] = set()
        for k in np.argsort(-score):
            if score[k] == -np.inf:
                break
            ids.update(v for v in self.ids[entries[k]] if v != name)
            if len(ids) >= top:
                return float(score[k])
        return -np.inf


def _sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings and ids of the n rows of smallest hash h."""
    found = rows.orderBy("h").limit(n).select("embedding", "id").toArrow().combine_chunks()
    return _matrix(found.column(0)) if len(found) else np.zeros((0, 1)), found.column(1).to_numpy()


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)
