import gc
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, licences, pii, quality, queries, token_files, toxicity, urls
from loomspark.llm.queries import tokenizer_path
from loomspark.llm.shared import fresh_path
from loomspark.llm.trees import BoostedTrees
from tests.llm import helpers

tokenizers = pytest.importorskip("tokenizers")


def test_bpe_equals_the_library(spark):
    path = tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = helpers.awkward(spark).withColumn("ids", F.lit("clash"))
    for row in bpe.encode(docs, path, ["n_tokens", "ids", "decoded"]).collect():
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want and row.n_tokens == len(want)
        assert row.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(helpers.empty(spark), path, ["ids"]).count() == 0


def test_bpe_leaves_nothing_in_workers(spark):
    docs = spark.createDataFrame([(i, helpers.sentence(i, 20)) for i in range(40)], "doc_id long, text string").repartition(4)

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ == "Encoder" for x in gc.get_objects())]})

    for _ in range(2):
        assert bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), ["n_tokens"]).count() == 40
        bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), ["ids"]).collect()
        after = [r.n for r in docs.mapInArrow(held, "n long").collect()]
        assert len(after) == 4 and not any(after)


def test_bpe_remembers_a_bounded_text():
    path = tokenizer_path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Encoder(path)
    for k in range(0, 250, 10):
        texts = [chr(97 + (k + i) % 26) * (20_000 + k + i) for i in range(10)]
        got = [ids for ids, _ in own.encode_batch(texts)]
        assert sum(map(len, own.ids)) < 4_000_000
    assert np.frombuffer(got[0], "<u4").tolist() == library.encode(texts[0], add_special_tokens=False).ids


def test_bpe_of_odd_texts():
    path = tokenizer_path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Encoder(path)
    texts = ["don't we'll 'S it's", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑ", "é" + chr(0x301), "x" * 5000, "a1b22 !!?", chr(0x130) + "I", chr(0x85) + "z" + chr(0x1C) + "z"]
    for text, (ids, decoded) in zip(texts, own.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == library.decode(want, skip_special_tokens=False) == own.decode(want)


def test_bpe_of_very_long_words():
    path = tokenizer_path("word_bpe_49k.json")
    library, own, rng = tokenizers.Tokenizer.from_file(path), bpe.Encoder(path), np.random.default_rng(6)
    began = time.perf_counter()
    for n in (63, 64, 65, 1000, 100_000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "aé", "a"):
            text = "".join(rng.choice(list(letters), n))
            assert np.frombuffer(next(own.encode_batch([text]))[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60


def test_token_files_round_trip(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    folder = fresh_path(spark, "test-tokens")
    token_files.write(helpers.awkward(spark).withColumns({c: F.lit("clash") for c in ("shard", "ids", "start", "spread")}), folder, path)
    rows = token_files.read(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    texts = {}
    for doc_id, text, *_ in helpers.awkward_rows():
        texts.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    start = 0
    for row in rows:
        assert row.start == start and row.n_tokens == len(row.ids)
        texts[row.doc_id].remove(row.ids)
        start += row.n_tokens
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.ids_crc32(token_files.read(spark, folder), ["doc_id", "start"]).collect()}
    for row in rows:
        assert sums[row.doc_id, row.start] == zlib.crc32(np.array(row.ids, "<u4").tobytes())
    assert [r.doc_id for r in token_files.lookup(spark, folder, [10]).collect()] == [10]
    other = fresh_path(spark, "test-tokens")
    token_files.write(helpers.empty(spark), other, path)
    assert token_files.read(spark, other).count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return pii.sort_spans(out)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    parts = list("aB1234567890.-+@ ()_%é\n") + ["1.2.3.4", "a@b.co", "+1 (617) 555-1234", "4111 1111 1111 1111"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert pii.base_spans(text) == plain_spans(text)


def test_spans_of_a_text_full_of_them():
    text = " ".join(f"mail a{i}@b.co token=24be64439e3e49cf46b2d7c90f{i:05d} call 555-{i % 900 + 100}-{i % 9000 + 1000}" for i in range(3500))
    began = time.perf_counter()
    base, every = pii.Detector().spans([text])[0]
    assert time.perf_counter() - began < 15 and len(base) == 3500
    for (_, end, _), (start, _, _) in zip(every, every[1:]):
        assert end <= start


def test_chosen_spans_equal_the_plain_choice():
    rng = np.random.default_rng(9)
    for _ in range(500):
        found = []
        for _ in range(rng.integers(0, 30)):
            a = int(rng.integers(0, 60))
            found.append((-float(rng.integers(1, 5)), (a, a + int(rng.integers(1, 15)), "number")))
        plain = []
        for _, span in sorted(found):
            if not any(a < span[1] and span[0] < b for a, b, _ in plain):
                plain.append(span)
        assert sorted(pii.chosen(found)) == sorted(plain)
        for a, b in rng.integers(0, 60, (20, 2)).tolist():
            span = (min(a, b), max(a, b) + 1, "x")
            assert pii.meets(pii.covered(plain), span) == any(x < span[1] and span[0] < y for x, y, _ in plain)


def test_detector_adds_secrets_and_redacts(spark):
    detector = pii.Detector()
    texts = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "nothing to see here", None, "", "mail a@b.co or 4111111111111111", "9" * 50_000, "( " * 50_000]
    found = detector.spans(texts)
    assert any(k == "secret" for *_, k in found[0][1]) and found[1] == ([], []) and found[2] == found[3] == ([], [])
    for (base, every), text in zip(found, texts):
        assert base == plain_spans(text or "") and set(base) <= set(every)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    clean = {r.doc_id: r.text for r in pii.redact(docs, detector).collect()}
    assert clean[4] == "mail [email] or [card]" and clean[2] is None and clean[1] == texts[1]
    assert pii.detect(helpers.awkward(spark), detector).count() == len(helpers.awkward_rows())
    assert pii.detect(helpers.empty(spark), detector).count() == 0


def test_url_rules_and_model(spark):
    rows = [
        (1, "http://a.example.net/en/x"), (2, "https://EXAMPLE.net/de/x?q"), (3, "http://x.example.com/de/1"), (4, "http://b.org/fr/"), (5, "http://net"), (6, None), (7, "no scheme/net/"), (8, "http://good.example.com/en/1"),
        (9, "http://cheap-casino-win777.xyz/free/bonus?a=1&b=2&c=3"), (9, "http://cheap-casino-win777.xyz/free/bonus?a=1&b=2&c=3"), (10, "a://b://net/x"), (11, ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("html", F.lit(None).cast("string"))
    model = urls.train()
    rows_out = urls.judge(pages, model).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows_out}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/x", "net/", "block")
    assert got[3] == ("x.example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("b.org", "/fr/", "org/fr/", "allow")
    assert got[5][:3] == ("net", "", None) and got[6][:3] == ("", "", None) == got[7][:3] == got[11][:3]
    assert got[8][2:] == (None, "allow") and got[9][2:] == (None, "block")
    assert got[10][0] == "b:"
    for r in rows_out:  # what no rule decides, the trees do, with or without a host
        if r.rule is None:
            assert abs(r.score - float(model.probability([r.url])[0])) < 1e-12 and r.verdict == ("block" if r.score >= 0.5 else "allow")
        else:
            assert r.score is None
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_url_query_equals_its_sql_in_host_path_and_rule(spark):
    folder = "/root/testdata/sf0.01"
    want = duckdb.sql(f"""
      WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM '{folder}/pages.parquet'),
      r(verdict, h, s) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
      f AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(verdict, length(h || s)) AS verdict FROM p JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
      SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN f USING (page_id)""").fetchall()
    got = queries.op10_url_filter(spark, folder).collect()
    ruled = sorted((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got)
    assert ruled == sorted(want) and len({r.rule for r in got}) > 3


def test_url_model_on_held_out_urls():
    model = urls.train()
    x, y = urls.labelled_urls(3000, seed=99)
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.95
    x, y = urls.labelled_urls(3000, 98, ("gambling", "bookmaker", "steroids", "knockoff", "sexcams", "moneyfast", "ringtones", "debtfree"))  # words that no training url holds
    judged = model.probability(x) >= 0.5
    assert (judged == y).mean() > 0.75 and judged[y == 0].mean() < 0.05
    own = urls.UrlModel(["http://a.b" + str(i) + (".bad/" if i % 2 else ".good/") for i in range(400)], np.arange(400) % 2)
    assert (own.probability(["http://x.bad/", "http://x.good/"]) >= 0.5).tolist() == [True, False]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = BoostedTrees(trees=40).fit(x[:3000], y[:3000])
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_ordinary_hosts_are_allowed_and_plain_lures_blocked():
    ordinary = [
        "https://github.com/apache/spark", "http://bank-of-spring.com/", "https://www.winfield.org/about", "https://pillar.edu/freedom", "https://en.wikipedia.org/wiki/Suffix_array",
        "https://www.nytimes.com/2023/05/01/technology/ai-google.html", "https://docs.python.org/3/library/re.html", "https://arxiv.org/abs/1706.03762", "https://www.loc.gov/collections/",
        "https://www.berlin.de/museum/index.html", "https://spark.apache.org/docs/latest/sql-ref.html", "https://www.nature.com/articles/s41586-020-2649-2", "https://news.ycombinator.com/item?id=8863",
        "https://www.bbc.co.uk/news/world-europe-66000000", "http://www.gutenberg.org/files/2701/2701-h/2701-h.htm", "https://www.python.org/downloads/",
    ]
    unwanted = [
        "http://buy-v1agra.ru/x", "http://cheap-pills-online.xyz/buy?aff=123", "http://casino-bonus777.top/", "http://free-crypto-giveaway.click/win", "http://replica-rolex-sale.net/watches.php?id=5",
        "http://192.168.4.22/secure-login/verify.php", "https://payday-loans-now.biz/apply",
    ]
    model = urls.train()
    assert model is urls.train()  # trained once a session
    assert [u for u, p in zip(ordinary, model.probability(ordinary)) if p >= 0.5] == []
    assert [u for u, p in zip(unwanted, model.probability(unwanted)) if p < 0.5] == []


def test_urls_of_any_length(spark):
    rows = [(1, "http://a.org/" + "x/" * 100_000), (2, "http://" + "b" * 100_000 + ".net/"), (3, "?" * 50_000), (4, None), (4, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.train()).collect()
    assert sorted((r.page_id, len(r.host), len(r.path), r.rule) for r in got) == [(1, 5, 200_001, None), (2, 100_004, 1, "net/"), (3, 0, 0, None), (4, 0, 0, None), (4, 0, 0, None)]


INSULTS = ("blarghead", "snotface", "wormling")


def toxic_rows(n):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = helpers.sentence(i, int(rng.integers(20, 120))).split()
        bad = int(rng.random() < 0.3)
        if bad:
            for _ in range(3):
                words[rng.integers(0, len(words))] = str(rng.choice(INSULTS))
        rows.append((i, " ".join(words), bad))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rows = toxic_rows(700)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows] + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    truth = {i: b for i, _, b in rows}
    got = toxicity.score(docs, model).select("doc_id", "score", toxicity.held_out().alias("held")).collect()
    for r in got:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.held]
    assert np.mean(held) > 0.9
    scorer = toxicity.Scorer(model)
    assert scorer.scores(["alpha1 blargheads beta2", "alpha1 beta2 gamma3"])[0] > 0.5
    assert max(scorer.scores([None, "", "alpha1"])) < 0.5
    assert toxicity.score(helpers.awkward(spark), model).count() == len(helpers.awkward_rows())
    assert toxicity.score(helpers.empty(spark), model).count() == 0


def test_toxicity_scores_equal_a_plain_rescoring(spark):
    """Every window of every document of the smallest table, word by word and n-gram by n-gram, with the trained model's vectors."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    weight = (toxicity.SCALE * (model.table @ (model.output[:, 1] - model.output[:, 0]))).astype(np.float32)
    bias = float(model.bias[1] - model.bias[0])
    known = {}

    def word_score(word):
        if word not in known:
            marked = f"<{word}>"
            parts = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked]
            known[word] = sum(float(weight[zlib.crc32(p.encode()) % toxicity.BUCKETS]) for p in parts) / len(parts)
        return known[word]

    for r in docs.collect():
        words = []
        for w in re.findall(r"[^\W\d_]+(?:['*@$0-9!_-]+[^\W\d_]+)*", (r.text or "").lower()):
            if not words or words[-1] != w:
                words.append(w)
        start, scores = 0, []
        while True:
            window = words[start : start + 24]
            scores.append(sum(map(word_score, window)) / max(1, len(window)))
            if start + 24 >= len(words):
                break
            start += 12
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(max(scores) + bias))), abs=1e-5)


def test_toxicity_learns_rare_insults(spark):
    rng = np.random.default_rng(8)
    rows = toxic_rows(1500)
    for i in range(1500, 1520):  # an insult of about 4 % of the toxic rows
        words = helpers.sentence(i, 60).split()
        for _ in range(3):
            words[rng.integers(0, len(words))] = "quixelstump"
        rows.append((i, " ".join(words), 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows], "doc_id long, quality int, toxic int")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    texts = [helpers.sentence(5000 + i, 40) for i in range(40)]
    assert np.mean([s < 0.5 for s in scorer.scores(texts)]) > 0.9
    assert np.mean([s >= 0.5 for s in scorer.scores([f"{t} quixelstump {t}" for t in texts])]) > 0.9


def test_toxicity_trains_on_whole_texts(spark):
    rows = []
    for i in range(160):
        words = helpers.sentence(i, 1500).split()[:1500]
        if i % 2:
            words[36] = "quixelstump"  # 32 evenly spread windows of 24 words of 1500 leave it out
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in got]) > 0.95


def test_toxicity_on_held_out_labels(spark):
    """The contract's fold of the smallest tables that hold enough toxic rows: most are found, none of the others is."""
    folder = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").collect()
    found = [r.predicted for r in got if r.toxic == 1]
    assert np.mean(found) > 0.8 and sum(r.predicted for r in got if r.toxic == 0) <= 3


def test_toxicity_of_very_long_and_repeated_texts(spark):
    rows = toxic_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows] + [(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    calm = helpers.sentence(9000, 20_000)
    low, high = scorer.scores([calm, f"{calm} blarghead {calm} snotface wormling"])
    assert low < high and scorer.scores([calm])[0] == low


def test_toxicity_without_labels(spark):
    model = toxicity.train(helpers.awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score(helpers.awkward(spark), model).collect())


def test_quality_posteriors(spark):
    rows = [(i, helpers.sentence(i, 60), "en", "good" if i % 2 else "mixed", 1) for i in range(200)] + [(1000 + i, "### $$$ %%% " * 30, "en", "mixed", 1) for i in range(100)]
    docs = spark.createDataFrame(rows + helpers.awkward_rows(), helpers.SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "host", "path", "host_posterior", "id", "own", "row", "_host")})
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in rows] + [(None, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.judge(docs, model, labels).collect()
    assert len(got) == len(rows) + len(helpers.awkward_rows()) and got[0]["host"] == "clash"
    by = {r.doc_id: r for r in got}
    assert by[1].keep and not by[1000].keep
    assert by[1].host_posterior > by[0].host_posterior
    assert 0 < by[1].path_posterior < 1
    assert quality.judge(helpers.empty(spark), quality.train(helpers.empty(spark), labels), labels).count() == 0
    assert {r.score for r in quality.judge(helpers.awkward(spark), quality.DocumentModel()).collect()} == {0.5}


def test_quality_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(12)
    rows = [(i, helpers.sentence(i, 50) if rng.random() < 0.7 else "## $ " * 40, str(rng.choice(["en", "de"])), f"s{rng.integers(0, 4)}" if i else None, 1) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, helpers.SCHEMA), spark.createDataFrame([(i, int("#" not in r[1]), 0) for i, r in enumerate(rows[:60])], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    told = {i: q for i, q, _ in [tuple(r) for r in labels.collect()] if zlib.crc32(str(i).encode()) % 5}
    x = model.log_odds(quality.features([r[1] for r in rows]))
    own = np.array([told.get(r[0], 1 / (1 + math.exp(-e))) for r, e in zip(rows, x)])

    def weight(groups):  # of (n, rate, mean)
        n, r, m = (np.array(v, float) for v in zip(*groups))
        spread = (n * (r - m) ** 2).sum() / n.sum() - (m * (1 - m)).sum() / n.sum()
        return min(10_000.0, max(1.0, (n * m * (1 - m)).sum() / n.sum() / spread - 1)) if spread > 0 else 10_000.0

    hosts, paths = {}, {}
    for r, g in zip(rows, own):
        for table, key in ((hosts, r[3]), (paths, (r[3], r[2]))):
            n, s = table.get(key, (0, 0.0))
            table[key] = n + 1, s + g
    rate = own.sum() / len(own)
    a = weight([(n, s / n, rate) for n, s in hosts.values()])
    shrunk = {h: (s + a * rate) / (n + a) for h, (n, s) in hosts.items()}
    b = weight([(n, s / n, shrunk[h]) for (h, _), (n, s) in paths.items()])
    want = {}
    for r, g, e in zip(rows, own, x):
        (n, s), (m, t) = hosts[r[3]], paths[r[3], r[2]]
        host = (s - g + a * rate) / (n - 1 + a)
        path = (t - g + b * host) / (m - 1 + b)
        want[r[0]] = 1 / (1 + math.exp(-(e - model.prior + math.log(path / (1 - path)))))
    for r in quality.judge(docs, model, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, folder).where(quality.held_out()).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("quality IS NOT NULL").collect()
    assert len(got) > 50 and np.mean([r.keep == bool(r.quality) for r in got]) > 0.97


def test_licences_equal_plain_dice(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "x Licensed under the Apache License Version 2.0", "this is released under the MIT license, really", "no licence here at all", "", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, None, "\n".join(lines), "Permission to use, copy,\nmodify, and/or distribute this software\nfor any purpose with or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."])], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.verdicts(licences.scan(docs.withColumn("matches", F.lit(1)))).collect()}
    assert got[0].licences == "Apache-2.0" and got[0].best_dice == 1.0
    a, b = set(licences.template_bigrams(lines[1])), set(licences.template_bigrams(licences.TEMPLATES[0][1]))
    assert got[1].best_dice == round(2 * len(a & b) / (len(a) + len(b)), 6)
    assert got[3].licences == got[4].licences == got[5].licences == got[6].licences == ""
    assert licences.verdicts(licences.scan(helpers.awkward(spark))).count() == len(helpers.awkward_rows())
    assert licences.scan(helpers.empty(spark)).count() == 0
