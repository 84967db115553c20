import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from loomspark.llm import runs
from tests.llm import helpers


def altered(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def brute(w):
    """All runs by trying every period at every place."""
    n, best = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def expected(doc_id, text):
    w = altered(doc_id, text)
    found = brute(w)
    drop = {i for a, n, q in found for i in range(a + q, a + n)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    digest = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
    return (doc_id, len(found), *first, digest, kept)


def test_runs_of_periodic_words_equal_brute_force():
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        w = []
        while len(w) < rng.randrange(20, 260):
            kind = rng.randrange(4)
            if kind == 0:
                w += [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 20))]
            else:
                part = [rng.choice("ab" if kind == 1 else "abcdef") for _ in range(rng.randrange(1, 16))]
                w += (part * 12)[: rng.randrange(10, 1 + 12 * len(part)) if len(part) > 1 else 30]
        texts.append(" ".join(w))
    # Fibonacci words, a period of a third, a run inside a run, runs that touch
    a, b = ["x"], ["x", "y"]
    while len(b) < 400:
        a, b = b, b + a
    texts += [" ".join(b), " ".join("abcdefgh" * 3), " ".join(("a" * 30 + "b") * 4), " ".join("a" * 30 + "b" * 30), " ".join("ab" * 12 + "a"), " ".join("a" * 23), " ".join("a" * 24)]
    got = [(w, r) for w, r in runs.runs_of(texts)]
    for text, (words, found) in zip(texts, got):
        assert words == text.encode().split()
        assert found == brute(words), text


def test_small_chunks_of_candidates(monkeypatch):
    monkeypatch.setattr(runs, "CANDIDATES", 3)
    text = " ".join(("a" * 30 + "b") * 4)
    assert next(runs.runs_of([text]))[1] == brute(text.encode().split())


def test_detect_equals_brute_force_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in helpers.awkward_rows() if r[0] != 11]
    rows += [(i, helpers.sentence(i, 20 + i % 70)) for i in range(100, 400)]
    rows += [(i, " ".join(["spam and eggs　now"] * (i % 40)) + " tail \x0b x") for i in range(400, 480)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS n_runs", "'x' AS extra")
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    out = runs.detect(docs, names, rule=runs.planted)
    assert out.columns == ["doc_id", "extra", *names]
    got = sorted((tuple(r) for r in out.drop("extra").collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)


def test_long_text_of_one_period_and_collapse(spark):
    word = "la " * 60_000
    docs = spark.createDataFrame([(1, "a b c", 3), (2, word, 1), (3, None, 2), (2, word, 1)], "doc_id long, text string, n int")
    got = {r.doc_id: r.runs for r in runs.detect(docs, ["runs"]).collect()}
    assert [tuple(x) for x in got[2]] == [(0, 60_000, 1)] and got[1] == got[3] == []
    kept = runs.collapse(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c", 3), (2, "la", 1), (3, None, 2), (2, "la", 1)], key=str)
    assert runs.detect(helpers.empty(spark), ["n_runs", "collapsed"]).count() == 0


def test_names_of_a_level_are_equal_for_equal_blocks_alone():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 3, 200)
    names = np.append(word, 99)
    for k, (named, live) in enumerate(runs.levels(names, np.append(np.ones(200, bool), False))):
        width = 1 << k
        blocks = [tuple(names[i : i + width]) for i in range(201)]
        for i in range(0, 201 - width, 7):
            for j in range(i + 1, 201 - width):
                if live[i] or live[j]:
                    assert (named[i] == named[j]) == (blocks[i] == blocks[j])
