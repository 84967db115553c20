"""Quality by hierarchical empirical Bayes: document evidence, host and path posteriors.

1. Document evidence: a logistic model on form features of the whole text (symbols, upper
   case, repeated words, separators), trained in numpy on a bounded labelled sample.
2. Hosts and paths (here the source, and the language within it): grouped sums over all
   documents, of labels where rows outside the held-out fold have them and of the document
   model's probabilities elsewhere. A path's rate is shrunk toward its host's and a host's
   toward the global one, each with a prior weight estimated by the method of moments, so
   that sparse sites say little.
3. Bayes' rule joins both: the document model's log-odds less those of the share of good rows
   it was trained on are what the text says whatever the site; the log-odds of the path's
   posterior are the prior. A document's own share is taken out of its host and path first,
   so that no evidence counts twice.

Defined results: null and empty texts have the evidence of a text without words; a null
source or language is a group of its own; repeated rows count as often as they occur; a
null doc_id is scored like any other, without a label; of different labels of one doc_id the
larger counts; without usable labels every document scores 0.5. Columns named as the results
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents train the document model: those whose hashed doc_id is smallest.
SAMPLE_ROWS = 4000
FEATURES = 9
_WORD = re.compile(r"[^\W\d_]+")


def features(texts: list[str | None]) -> np.ndarray:
    """Form features of whole texts."""
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        text = text or ""
        n = len(text)
        raw = text.encode("utf-8", "replace")
        code = np.frombuffer(raw, dtype=np.uint8)
        counts = np.bincount(code, minlength=256) if len(code) else np.zeros(256)
        size = max(len(code), 1)
        letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
        words = text.split()
        total = max(len(words), 1)
        repeats = sum(a == b for a, b in zip(words, words[1:])) / total
        out[i] = [
            np.log1p(n),
            counts[[33, 35, 36, 37, 38, 42, 64, 124]].sum() / size * 10,
            counts[65:91].sum() / max(letters, 1) * 4,
            repeats * 4,
            len(set(words)) / total,
            sum(map(len, words)) / total / 10,
            counts[124] / size * 20,
            counts[48:58].sum() / size * 10,
            float(not words),
        ]
    return out


class DocumentModel:
    """A logistic model on features and their squares; Newton steps with a ridge."""

    def __init__(self, weights: np.ndarray | None = None, mean: np.ndarray | None = None, spread: np.ndarray | None = None):
        self.weights, self.mean, self.spread = weights, mean, spread
        #: Log-odds of the share of good rows among those trained on.
        self.prior = 0.0

    def _x(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z**2], axis=1)

    def fit(self, raw: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> DocumentModel:
        if len(y) == 0 or y.min() == y.max():
            return self
        self.prior = float(np.log(y.mean() / (1 - y.mean())))
        self.mean, self.spread = raw.mean(axis=0), raw.std(axis=0) + 1e-6
        x, w = self._x(raw), np.zeros(2 * FEATURES + 1)
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
            step = np.linalg.solve(hessian, x.T @ (y - p) - penalty @ w)
            w = w + step / max(1.0, np.abs(step).max() / 2)
        self.weights = w
        return self

    def log_odds(self, raw: np.ndarray) -> np.ndarray:
        return np.zeros(len(raw)) if self.weights is None else np.clip(self._x(raw) @ self.weights, -12, 12)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that neither train nor count as labelled at their sites: crc32 of the id's text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality, 0 or 1, once for each id outside the held-out fold."""
    return labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DocumentModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fold: those of smallest hashed id, and of repeated ids the first texts."""
    picked = usable_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
    x, y = [], []
    for row in found.select("text", "quality").toLocalIterator():
        x.append(features([row.text])[0])
        y.append(row.quality)
    return DocumentModel().fit(np.array(x).reshape(-1, FEATURES), np.array(y, dtype=np.float64))


def evidence(docs: DataFrame, model: DocumentModel, text: str = "text", out: str = "evidence") -> DataFrame:
    """docs without the text and with the log-odds of the document model."""
    kept = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            column = batch.column(batch.schema.get_field_index(text))
            for a in range(0, len(column), 512):
                values.append(model.log_odds(features(column.slice(a, 512).to_pylist())))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(np.concatenate(values) if values else np.zeros(0))], names=[*kept, out])

    shape = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("double").alias(out))
    return docs.mapInArrow(run, shape.schema)


def prior_weight(groups: DataFrame, rate: str, n: str, mean: str) -> DataFrame:
    """Method of moments: how many documents a prior is worth, between 1 and 10 000.

    Of groups of size n with rate r around mean m, the spread beyond m(1 - m)/n is the groups' own.
    """
    own = F.sum(F.col(n) * (F.col(rate) - F.col(mean)) ** 2) / F.sum(n) - F.sum(F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    typical = F.sum(F.col(n) * F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    weight = F.when(own > 0, typical / own - 1).otherwise(10_000.0)
    return groups.agg(F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), F.coalesce(weight, F.lit(10_000.0)))).alias("weight"))


def site_posteriors(scored: DataFrame, host: str = "host", path: str = "path", good: str = "good") -> DataFrame:
    """One row for each host and path: n, good, host_n, host_good, host_posterior, path_posterior, global_rate and both prior weights.

    Groups are summed before the shuffle, and written once; all that follows reads that small table.
    """
    from loomspark.llm.shared import materialise

    paths = materialise(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg((F.sum("host_good") / F.sum("host_n")).alias("global_rate"))
    hosts = hosts.crossJoin(F.broadcast(total)).withColumn("host_rate", F.col("host_good") / F.col("host_n"))  # one row
    host_weight = prior_weight(hosts, "host_rate", "host_n", "global_rate").withColumnRenamed("weight", "host_weight")
    hosts = hosts.crossJoin(F.broadcast(host_weight)).select(  # one row
        "host", "host_n", "host_good", "global_rate", "host_weight", posterior(F.col("host_good"), F.col("host_n"), F.col("host_weight"), F.col("global_rate")).alias("host_posterior")
    )
    hosts = materialise(hosts, "quality-hosts")
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]).withColumn("path_rate", F.col("good") / F.col("n"))
    path_weight = prior_weight(joined, "path_rate", "n", "host_posterior").withColumnRenamed("weight", "path_weight")
    whole = joined.crossJoin(F.broadcast(path_weight))  # one row
    return whole.withColumn("path_posterior", posterior(F.col("good"), F.col("n"), F.col("path_weight"), F.col("host_posterior"))).drop("path_rate")


def posterior(good: Column, n: Column, weight: Column, prior: Column) -> Column:
    """The rate of a group shrunk toward its prior, which is worth ``weight`` documents."""
    return (good + weight * prior) / (n + weight)


def _logit(p):
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(clipped / (1 - clipped))


#: Copies of each site's row, so that the documents of one host are joined in as many places.
SALTS = 8
RESULTS = ["evidence", "host_posterior", "path_posterior", "score", "keep"]


def judge(docs: DataFrame, model: DocumentModel, labels: DataFrame | None = None, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """docs without the text, with evidence, host_posterior, path_posterior, score and keep. labels (doc_id, quality) speak for their sites."""
    from loomspark.llm.shared import materialise

    own = [c for c in docs.columns if c not in (*RESULTS, "text")]
    # the row's own columns travel as one, so that none can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), "text")
    scored = evidence(packed, model)
    if labels is not None:
        scored = scored.join(usable_labels(labels).select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    else:
        scored = scored.withColumn("quality", F.lit(None).cast("int"))
    good = F.coalesce(F.col("quality").cast("double"), 1 / (1 + F.exp(-F.col("evidence"))))
    scored = materialise(scored.withColumn("own", good), "quality-evidence")  # two passes read it: the sites' and the documents'
    sites = site_posteriors(scored, good="own").select(F.col("host").alias("h"), F.col("path").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "n", "good", "host_n", "host_good", "global_rate", "host_weight", "path_weight", "host_posterior", "path_posterior")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("id", "evidence"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sites, salted["host"].eqNullSafe(F.col("h")) & salted["path"].eqNullSafe(F.col("p")) & (salted["salt"] == sites["salt"]))
    others_host = posterior(F.col("host_good") - F.col("own"), F.col("host_n") - 1, F.col("host_weight"), F.col("global_rate"))
    others = posterior(F.col("good") - F.col("own"), F.col("n") - 1, F.col("path_weight"), others_host)
    score = 1 / (1 + F.exp(-(F.col("evidence") - F.lit(model.prior) + _logit(others))))
    return joined.select("row.*", "evidence", "host_posterior", "path_posterior", score.alias("score")).withColumn("keep", F.col("score") >= threshold)
