"""Every registered query with a DuckDB twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pytest

from loomspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_twin(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


#: Words of the rules beside letters of other scripts, signs and ends of lines.
ODD = [
    "Straßbeach und ßfamily", "does, kindesö pottery", "doías de y", "Óbeach", "mañart pets", "dóes", "wherever whoß", "éwho", "wanna 我who", "beaché", "K\u2028what would\u0085 x\r likely be", "what would\n likely be",
    "\u0131s it", "Is it?", "\u212Aids and kids", "events1 _event", "what å might", "a\u0301who", "who\u0301", " where ", "", None, "unknown", " N/A ", "ﬁeld pottery\u200d", "familyö", "readü books", "einart", "xx ßart", "ßart\ttypes",
]


def _equals_its_twin_on_odd_turns(spark, folder, name):
    turns = [(i, t, ["user", "assistant"][t % 2], ODD[(i + t * (i % 7 + 1)) % len(ODD)]) for i in range(3 * len(ODD)) for t in range(4)]
    path = f"{folder}/conversations.parquet"
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    got, want = catalog.queries()[name](spark, str(folder)), con.sql(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_evidence_blocks_beside_letters_of_other_scripts(spark, tmp_path):
    _equals_its_twin_on_odd_turns(spark, tmp_path, "evidence_block_rank")


def test_question_rules_beside_letters_of_other_scripts(spark, tmp_path):
    _equals_its_twin_on_odd_turns(spark, tmp_path, "question_rules")


def test_names_are_complete():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 60
