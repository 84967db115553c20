import re

import numpy as np
import pytest

from loomspark.llm import jaccard, shingles
from tests.llm import helpers

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(out, key=str)


def near_copies():
    rows = []
    for g in range(12):
        words = helpers.sentence(100 + g, 30 + 12 * g).split()
        for k in range(9):
            w = list(words)
            for e in range(k % 5):
                w[(e * 13 + k) % len(w)] = f"edit{k}"
            rows.append((g * 9 + k, " ".join(w + ["tail"] * (k % 3))))
    shared = helpers.sentence(77, 25)
    return rows + [(1000 + k, shared + " " + helpers.sentence(200 + k, 20 + k)) for k in range(30)]


@pytest.mark.parametrize("chunk", [1_000_000, 300])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", chunk)
    rows = near_copies() + [(r[0], r[1]) for r in helpers.awkward_rows() if r[0] not in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.duplicate_groups(docs).collect()), key=str)
    assert got == brute(rows)


def test_awkward_rows_and_one_of_each(spark):
    docs = helpers.awkward(spark)
    got = sorted(map(tuple, jaccard.duplicate_groups(docs).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in helpers.awkward_rows()])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12, 12]


def test_one_of_each_judges_rows_of_a_repeated_id(spark):
    a, b, c, d, e = (helpers.sentence(700 + k, 60) for k in range(5))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c + " end"), (5, d), (5, e), (5, d.upper()), (2, ""), (None, a), (6, b + " end")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted(((r.doc_id, r.text) for r in kept if r.doc_id != 4), key=str)
    assert texts == sorted([(1, a), (2, b), (5, d.upper()), (5, e), (2, ""), (None, a)], key=str)
    assert [r.text in (c, c + " end") for r in kept if r.doc_id == 4] == [True]


@pytest.mark.parametrize("sets", [16_384, 4])
def test_blocks_of_many_small_sets_are_split(spark, monkeypatch, sets):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", sets)
    rows = [(i, f"a b c d e f g h i j{i % 7} k{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.duplicate_groups(docs).collect()), key=str) == brute(rows)


def test_clashing_columns_and_ids_of_text(spark):
    names = ["_rows", "_gone", "_set", "_id", "_marked", "__key"]
    rows = [("x1", "one two three four five six"), ("x2", "one two three four five six"), ("x3", "other"), (None, "other")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id string, text string, " + ", ".join(f"{n} int" for n in names))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or "" for r in kept.collect())) == ["", "x1", "x3"]


def test_empty_table(spark):
    assert jaccard.duplicate_groups(helpers.empty(spark)).count() == 0
    assert jaccard.one_of_each(helpers.empty(spark)).count() == 0


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        core = rng.integers(0, 2**52, rng.integers(5, 300), dtype=np.uint64)
        for _ in range(4):
            keep = core[rng.random(len(core)) > 0.08]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**52, len(core) // 20, dtype=np.uint64)])))
    size = np.array([len(s) for s in sets])
    maps = shingles.bitmaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), shingles.signature_bits(size))
    left, right = jaccard.candidate_pairs(size, maps)
    found = {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                assert (j, i) in found


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 60)] + [(100, 101), (101, 102)], "a long, b long")  # any ordered type
    roots = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert {roots[i] for i in range(2, 61)} == {1} and roots[101] == roots[102] == 100
