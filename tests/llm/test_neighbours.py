import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import neighbours, queries


def frame(spark, vectors, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], f"vec_id long, embedding array<{kind}>")


def recall(spark, vectors, every, top=5):
    """Share of the exact nearest, by brute force, that the search finds."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = np.arange(0, len(vectors), every)
    product = unit[asked] @ unit.T
    product[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-product, top, axis=1)[:, :top]
    got = {}
    for r in neighbours.search(frame(spark, vectors, "float"), F.col("vec_id") % every == 0, top).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got[q] & set(w)) / top for q, w in zip(asked.tolist(), want.tolist())])


@pytest.fixture
def visited(monkeypatch):
    """The shares of cells that searches visit."""
    shares, reach = [], neighbours.Index.reach

    def noted(self, *args):
        shares.append(reach(self, *args) / len(self.centroids))
        return round(shares[-1] * len(self.centroids))

    monkeypatch.setattr(neighbours.Index, "reach", noted)
    return shares


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((200, 64))[rng.integers(0, 200, n)] + 0.3 * rng.standard_normal((n, 64))


def test_recall_without_clusters(spark, visited):
    assert recall(spark, np.random.default_rng(3).standard_normal((12_000, 64)), 60) >= 0.9
    assert visited[0] < 0.8


def test_recall_with_clusters_where_few_cells_are_visited(spark, visited, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 3000)
    assert recall(spark, clustered(40_000), 100) >= 0.9
    assert visited[0] < 0.1


def test_recall_in_crowded_clusters():
    """What codes lose: of 500 entries in each of 200 clusters the nearest must be among those that are scored exactly."""
    unit = neighbours.normalised(clustered(100_000))
    index = neighbours.Index(unit[np.random.default_rng(1).permutation(len(unit))[:20_000]], 632)
    cell, codes = index.assign(unit)
    asked = np.arange(0, 100_000, 500)
    product = unit[asked] @ unit.T
    product[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-product, 5, axis=1)[:, :5]
    places, kept = codes.astype(int) + neighbours.CODEWORDS * np.arange(codes.shape[1]), []
    for q, near, own in zip(asked, index.probes(unit[asked], 6), want):
        entries = np.flatnonzero(np.isin(cell, near))
        products, words = index.tables(unit[q])
        estimate = products[cell[entries]] + words[places[entries]].sum(axis=1)
        kept.append(np.isin(own, entries[np.argsort(-estimate)[: neighbours.RERANK]]).mean())
    assert np.mean(kept) >= 0.95


@pytest.mark.parametrize("spread", [1e-3, 1e-5])
def test_recall_where_all_vectors_point_almost_one_way(spark, spread):
    assert recall(spark, 1 + spread * np.random.default_rng(11).standard_normal((6000, 64)), 60) >= 0.9


def test_recall_of_long_vectors_and_in_tight_crowds(spark):
    rng = np.random.default_rng(13)
    assert recall(spark, rng.standard_normal((3000, 512)), 50) >= 0.9
    crowd = np.minimum(99, rng.pareto(0.7, 12_000).astype(int))
    assert recall(spark, rng.standard_normal((100, 64))[crowd] + 0.02 * rng.standard_normal((12_000, 64)), 100) >= 0.9


def test_an_id_of_many_near_vectors_takes_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * k]) for k in range(1, 20)] + [(2 + k, [1.0, 0.1 + 0.1 * k]) for k in range(6)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_every_query_gets_its_number_of_neighbours(spark):
    rng = np.random.default_rng(17)
    pairs = np.repeat(rng.standard_normal((600, 16)), 2, axis=0) + 1e-3 * rng.standard_normal((1200, 16))
    crowd = rng.standard_normal(16) + 0.01 * rng.standard_normal((1200, 16))
    rows = [(i, v) for i, v in enumerate(np.concatenate([crowd, pairs]).tolist())]
    asked = [i for i, _ in rows if i % 50 == 0]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == dict.fromkeys(asked, 5)


def plain(rows, asked, top):
    """Every query's nearest by brute force, in double precision."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i in asked}):
        best = {}
        for own in (v for i, v in good if i == q):
            for i, v in good:
                if i != q:
                    best[i] = max(best.get(i, -2), float(own @ v / math.sqrt(own @ own) / math.sqrt(v @ v)))
        out += [(q, k + 1, i, round(s, 9)) for k, (s, i) in enumerate(sorted((-round(s, 12), i) for i, s in best.items())[:top])]
    return [(q, k, i, -s) for q, k, i, s in out]


def test_awkward_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "REACH", 1.0)  # the table trains the index, so its neighbours' cells are all visited
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(12)] + [(200, rows[5][1]), (200, rows[5][1]), (200, rows[6][1])]  # ties, repeats, one id with two vectors
    rows += [(300, None), (301, [0.0] * 8), (302, [math.nan] * 8), (303, [math.inf] + [1.0] * 7), (304, [1.0, None] + [0.0] * 6), (None, rows[1][1]), (305, [])]
    rows += [(400, [x * 1e200 for x in rows[9][1]]), (401, [x * 1e-200 for x in rows[11][1]])]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, score string, cell int")
    got = neighbours.search(table, (F.col("vec_id") % 5 == 0) & (F.col("cell") == 1), 5)
    scaled = [(i, v if i not in (400, 401) else rows[9 if i == 400 else 11][1]) for i, v in rows]
    want = plain(scaled, {i for i, _ in rows if i is not None and i % 5 == 0}, 5)
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.orderBy("query_id", "rank").collect()] == want


def test_query_equals_brute_force_on_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = plain(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = queries.op3_neighbours(spark, folder).orderBy("query_id", "rank").collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert np.mean([(q, i) in found for q, _, i, _ in want]) >= 0.9
    exact = {(q, i): s for q, _, i, s in plain(rows, {i for i, _ in rows if i % 50 == 0}, len(rows))}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-8 for r in got)
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] * (len(got) // 5)


def test_visits_follow_the_vectors():
    close = neighbours.normalised(clustered(5000))
    apart = neighbours.normalised(np.random.default_rng(5).standard_normal((5000, 64)))
    few, many = (neighbours.Index(x, 100).reach(x[:300], x, 5) for x in (close, apart))
    assert few < 20 and many > 40


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (1, [1.0, 0.0])]])
def test_no_neighbours(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert neighbours.search(frame, F.lit(True)).count() == 0
    assert neighbours.search(frame, F.lit(False)).count() == 0
