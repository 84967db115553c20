import collections
import random
import re
import zlib

import pytest

from loomspark.llm import spelling
from tests.llm import helpers

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(n):
    form, many = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        many[w] = len(close)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], many[w], n.get(form[w])))
    return sorted(out, key=str)


def texts():
    rng = random.Random(8)
    base = ["beginning", "necessary", "étranger", "straßenbahn", "Receive", "aaaaaaa", "aaaaaaaa", "naïvetés", "bookkeeper", "Étranger", "abcdefg×h"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.06:
                k, c = rng.randrange(len(w)), rng.choice("abe")
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.title()]) if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "-1-"]).join(words)))
    return rows


@pytest.mark.parametrize("chunk", [1 << 18, 20])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "_CHUNK", chunk)
    rows = texts() + [(r[0], r[1]) for r in helpers.awkward_rows()] + [(None, "unnamed unnamed unnamed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "text AS word")
    got = spelling.variants(spelling.word_counts(docs, rule=spelling.misspelt))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(counts(rows))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[1] is not None for r in want) > 20


def test_chains_ties_and_long_words(spark):
    n = {"aaaaaaaab": 2, "aaaaaaabb": 25, "aaaaaabbb": 300, "aaaaabbbb": 4000, "aaaabbbbb": 50_000, "zzzzzzz1": 3, "tieséaa": 30, "tiesêaa": 30, "tiesëaa": 3, "q" * 3000: 2, "q" * 3001: 40, "q" * 1500 + "r" + "q" * 1499: 7}
    n = {w: k for w, k in n.items() if "1" not in w}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(frame).collect()), key=str) == brute(n)


def test_empty_table_and_words_alone(spark):
    none = spelling.word_counts(helpers.empty(spark))
    assert spelling.variants(none).count() == 0
    frame = spark.createDataFrame([("solitary", 5)], "word string, n long")
    assert list(map(tuple, spelling.variants(frame).collect())) == [("solitary", None, "solitary", 5, 0, None)]
