import re
import time

from pyspark.sql import functions as F

from loomspark.llm import decontaminate
from tests.llm import helpers

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, helpers.sentence(3, 14)), (2, "one"), (3, None), (4, ""), (None, helpers.sentence(2, 12)), (1, helpers.sentence(3, 14)), (5, "ALPHA beta, gamma " + helpers.sentence(1, 12))]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, body in ITEMS:
        b = words(body)
        k = min(10, len(b))
        for o in range(len(b) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == b[o : o + k]:
                    hit.update(range(p, p + k))
                    items.add(item)
    return len(w), len(hit), sorted(str(i) for i in items - {None})


def brute_longest(text):
    """The longest run of words that stands in the text and in an item, of those that hold a window; the first, then the smallest item."""
    w, best = words(text), []
    for item, body in ITEMS:
        b = words(body)
        for o in range(len(b)):
            for p in range(len(w)):
                n = 0
                while o + n < len(b) and p + n < len(w) and b[o + n] == w[p + n]:
                    n += 1
                if n and n >= min(10, len(b)):
                    best.append((-n, p, item is None, str(item) if item is not None else ""))
    return (-min(best)[0], min(best)[1], min(best)[3] or None) if best else (0, None, None)


def test_equals_brute_force(spark):
    docs = helpers.awkward(spark).withColumn("n_hit", F.lit("clash")).withColumn("extra", F.lit(1))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(helpers.awkward_rows())
    for row in got:
        assert (row.n_words, row.n_hit, row["items"]) == brute(row.text)
        assert (row.n_longest, row.longest_at, row.longest_item) == brute_longest(row.text)
        assert row.contaminated == (row.n_hit > 0) and row.extra == 1
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute(r[1])[1] for r in helpers.awkward_rows())


def test_longest_matches_give_places(spark):
    text = "zero " + helpers.sentence(3, 14) + " tail"
    docs = spark.createDataFrame([(1, text), (2, helpers.sentence(3, 12)), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, helpers.sentence(3, 14))], "item_id long, text string")
    rows = decontaminate.longest_matches(docs, bench).collect()
    first = [r for r in rows if r.item_word == 0]
    assert [(r.doc_id, r.doc_word, r.n_words) for r in first] == [(1, 1, 14)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(helpers.empty(spark), bench).count() == 0
    assert decontaminate.contamination(helpers.awkward(spark), bench).where("contaminated").count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for row in decontaminate.contamination(helpers.awkward(spark), bench).collect():
        assert (row.n_words, row.n_hit, row["items"]) == brute(row.text)


def test_a_very_long_item_costs_no_more_than_its_words(spark):
    item = helpers.sentence(3, 20_000)
    bench = spark.createDataFrame([(1, item), (2, helpers.sentence(5, 12))], "item_id long, text string")
    docs = spark.createDataFrame([(k, item) for k in range(3)] + [(3, helpers.sentence(6, 4000)), (4, helpers.sentence(5, 12))], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert time.perf_counter() - began < 20
    assert got[0] == got[1] == got[2] == (20_000, ["1"]) and got[3] == (0, []) and got[4] == (12, ["2"])


def test_longest_matches_of_a_long_item(spark):
    item = helpers.sentence(3, 300)
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, " ".join(item.split()[50:250])), (3, item)], "doc_id long, text string")
    rows = decontaminate.longest_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), at_least=60).collect()
    want = {(o, d, o + (d == 1), 300 - o) for o in range(241) for d in (1, 3)}
    assert {(r.item_word, r.doc_id, r.doc_word, r.n_words) for r in rows} == want
