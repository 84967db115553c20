"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 5, with word
borders) and of its whole form, all hashed into one table; so a misspelling shares most of
its parts with the word it hides. A window of words is the mean of its word vectors, and a
linear softmax over two classes gives its score. Documents are long and one insult is
enough, so a document scores as its worst window, and training takes, of a toxic document,
the window the model finds worst so far, and of a clean one its worst and other windows.

Because everything up to the softmax is linear, the score of a window is a mean of word
scores: scoring a corpus needs one number for each n-gram, which is all that is sent to the
executors, and one for each word, remembered by each worker.

Defined results: null and empty texts score as a window without words (the bias alone);
labels that are null or not 0 or 1 train nothing; of different labels of one doc_id the
larger counts, and each row that repeats a doc_id is a training text of its own; without any
usable labels nothing is toxic. A score of exactly 0.5 counts as toxic. Empty tables give empty ones.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents train the model: those whose hashed doc_id is smallest.
SAMPLE_ROWS = 4000
WINDOW, STEP = 24, 12
BUCKETS, DIMENSION = 1 << 20, 8
EPOCHS, DECAY = 8, 0.02
#: An n-gram is learnt at full rate where its log-odds lie SURE standard errors from none, slower below; the log-odds
#: and errors of counts to which PRIOR_DOCS documents of average class are added, so that one document alone says little.
SURE, PRIOR_DOCS = 4.0, 1.0
#: Epochs and this weight of a lost clean document were chosen by cross-validation inside the training rows.
CLEAN_WEIGHT = 2
#: The softmax's fixed temperature: one word in a window can turn it.
SCALE = WINDOW
CACHE_WORDS = 120_000

_WORD = re.compile(r"[^\W\d_]+(?:['*@$0-9!_-]+[^\W\d_]+)*")


def grams(word: str) -> list[int]:
    """Buckets of a word's character n-grams and of the word itself."""
    marked = f"<{word}>"
    parts = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(p.encode("utf-8")) % BUCKETS for p in (*parts, marked)]


class SubwordModel:
    def __init__(self):
        self.table = np.zeros((BUCKETS, DIMENSION), dtype=np.float32)
        self.output = np.full((DIMENSION, 2), DIMENSION**-0.5, dtype=np.float32) * np.array([-1, 1], np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def fit(self, rows: Iterable[tuple[str | None, int]], epochs: int = EPOCHS, rate: float = 0.1, seed: int = 11) -> SubwordModel:
        """Train on documents and their labels, 0 or 1, taking them one at a time. Table and softmax move together, by Adagrad.

        The loss is the cross-entropy, both classes weighing alike. N-grams move the faster the surer their counts tell the
        classes apart, however rare they are.
        """
        rng = np.random.default_rng(seed)
        place: dict[str, int] = {}
        told: list[int] = []
        words: list[np.ndarray] = []
        for text, label in rows:
            told.append(label)
            words.append(np.array([place.setdefault(w, len(place)) for w in tokens(text)], dtype=np.int32))
        labels = np.array(told, dtype=np.int64)
        # the windows that scoring takes; of flat they are ranges, which overlap
        lengths = np.array([len(ids) for ids in words], dtype=np.int64)
        windows = np.maximum(1, -(-(lengths - WINDOW + STEP) // STEP))
        owners = np.repeat(np.arange(len(words)), windows)
        within = STEP * (np.arange(len(owners)) - np.repeat(np.cumsum(windows) - windows, windows))
        start = np.repeat(np.cumsum(lengths) - lengths, windows) + within
        size = np.minimum(WINDOW, lengths[owners] - within)
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        del words
        # every fourth document only sets the threshold: what trained scores better than it should
        aside = rng.permutation(len(labels)) % 4 == 0
        trains = ~aside[owners]
        toxic, clean = np.flatnonzero(trains & (labels[owners] == 1)), np.flatnonzero(trains & (labels[owners] == 0))
        if not len(toxic) or not len(clean):
            self.bias[:] = (0.0, -6.0) if not len(toxic) else (-6.0, 0.0)
            return self
        parts = [np.array(grams(w), dtype=np.int64) for w in place]
        part_size = np.array([len(p) for p in parts], dtype=np.int64)
        part_flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        part_start = np.cumsum(part_size) - part_size
        rates = rate * self._evidence(flat, start, size, owners, labels, part_flat, part_start, part_size)
        memory_table = np.full(BUCKETS, 1e-10, np.float64)
        memory_output, memory_bias = np.full((DIMENSION, 2), 1e-4), np.full(2, 1e-4)
        for epoch in range(epochs):
            scores = self._window_scores(part_flat, part_start, part_size, flat, size, start)
            chosen_toxic = worst(scores[toxic], owners[toxic], toxic) if epoch > 1 else toxic
            chosen_clean = worst(scores[clean], owners[clean], clean)
            other = rng.choice(clean, size=min(len(clean), 2 * len(chosen_clean)), replace=False)
            chosen = np.concatenate([chosen_toxic, chosen_clean, other])
            share_toxic = len(chosen_toxic) / len(chosen)
            balance = np.array([0.5 / (1 - share_toxic), 0.5 / share_toxic])
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), 256):
                w = chosen[order[a : a + 256]]
                ids = flat[_ranges(start[w], size[w])]
                row = np.repeat(np.arange(len(w)), size[w])
                unique, inverse = np.unique(ids, return_inverse=True)
                buckets = part_flat[_ranges(part_start[unique], part_size[unique])]
                of_word = np.repeat(np.arange(len(unique)), part_size[unique])
                vectors = _sum_rows(self.table[buckets], of_word, len(unique)) / np.maximum(part_size[unique], 1)[:, None]
                hidden = _sum_rows(vectors[inverse], row, len(w)) / np.maximum(size[w], 1)[:, None]
                logit = SCALE * (hidden @ self.output) + self.bias
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                y = labels[owners[w]]
                p[np.arange(len(w)), y] -= 1
                p *= balance[y][:, None] / len(w)
                back = SCALE * (p @ self.output.T) / np.maximum(size[w], 1)[:, None]
                g_word = _sum_rows(back[row], inverse, len(unique)) / np.maximum(part_size[unique], 1)[:, None]
                touched, bucket_row = np.unique(buckets, return_inverse=True)
                g_table = _sum_rows(g_word[of_word], bucket_row, len(touched)) + DECAY * self.table[touched] / len(order)
                memory_table[touched] += (g_table**2).mean(axis=1)
                self.table[touched] -= (rates[touched][:, None] * g_table / np.sqrt(memory_table[touched])[:, None]).astype(np.float32)
                g_output, g_bias = SCALE * hidden.T @ p, p.sum(axis=0)
                memory_output += g_output**2
                memory_bias += g_bias**2
                self.output -= (rate * g_output / np.sqrt(memory_output)).astype(np.float32)
                self.bias -= (rate * g_bias / np.sqrt(memory_bias)).astype(np.float32)
        # a document is its worst window, so the softmax's zero is set where documents divide best
        best = np.full(len(labels), -np.inf)
        np.maximum.at(best, owners, self._window_scores(part_flat, part_start, part_size, flat, size, start))
        judged = aside if (labels[aside] == 1).any() and (labels[aside] == 0).any() else ~aside
        # and never below what a window without words scores
        self.bias[1] -= np.float32(max(_cut(best[judged], labels[judged]), float(self.bias[1] - self.bias[0]) + 1.0))
        return self

    @staticmethod
    def _evidence(flat, start, size, owners, labels, part_flat, part_start, part_size) -> np.ndarray:
        """From 0 to 1, how surely each bucket's training documents tell the classes apart."""
        counts = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
        edges = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):  # one document at a time keeps memory small
            words = np.unique(flat[start[a] : start[b - 1] + size[b - 1]])
            buckets = np.unique(part_flat[_ranges(part_start[words], part_size[words])])
            counts[int(labels[owners[a]])][buckets] += 1
        total = np.array([(labels == k).sum() for k in (0, 1)])
        padded = [counts[k] + PRIOR_DOCS * total[k] / total.sum() for k in (0, 1)]
        odds = np.log(padded[1] / (total[1] + PRIOR_DOCS)) - np.log(padded[0] / (total[0] + PRIOR_DOCS))
        return np.minimum(1, np.abs(odds) / np.sqrt(1 / padded[0] + 1 / padded[1]) / SURE) ** 2

    def _window_scores(self, part_flat, part_start, part_size, flat, size, start) -> np.ndarray:
        each = (self.table @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)[part_flat]
        sums = np.concatenate([[0.0], np.cumsum(each)])
        word = (sums[part_start + part_size] - sums[part_start]) / np.maximum(part_size, 1)
        sums = np.concatenate([[0.0], np.cumsum(word[flat])])
        return SCALE * (sums[start + size] - sums[start]) / np.maximum(size, 1) + float(self.bias[1] - self.bias[0])

    def weights(self) -> np.ndarray:
        """What each bucket adds to a window's log-odds, before the divisions by the numbers of n-grams and of words."""
        return (SCALE * (self.table @ (self.output[:, 1] - self.output[:, 0]))).astype(np.float32)


def word_scores(weights: np.ndarray, words: list[str]) -> list[float]:
    """What each word adds to a window's log-odds, before the division by the window's length."""
    out: list[float] = []
    for a in range(0, len(words), 20_000):
        parts = [grams(w) for w in words[a : a + 20_000]]
        size = np.array([len(p) for p in parts])
        flat = np.fromiter((b for p in parts for b in p), dtype=np.int64, count=int(size.sum()))
        out += (np.add.reduceat(weights[flat].astype(np.float64), np.cumsum(size) - size) / size).tolist() if len(size) else []
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _sum_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of a matrix by group."""
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)


def worst(scores: np.ndarray, owners: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The highest-scoring window of each document."""
    order = np.lexsort((-scores, owners))
    first = np.concatenate([[True], owners[order][1:] != owners[order][:-1]])
    return index[order[first]]


def _cut(best: np.ndarray, labels: np.ndarray) -> float:
    """The log-odds that part the documents best, in the middle of the gap there; a clean one lost weighs CLEAN_WEIGHT times."""
    order = np.argsort(best)
    value, toxic = best[order], labels[order] == 1
    # errors when all from place k on are called toxic: toxic ones before k, clean ones from k on
    errors = np.concatenate([[0], np.cumsum(toxic)]) + CLEAN_WEIGHT * ((~toxic).sum() - np.concatenate([[0], np.cumsum(~toxic)]))
    k = int(len(errors) - 1 - np.argmin(errors[::-1]))
    low = value[k - 1] if k else value[0] - 1
    high = value[k] if k < len(value) else value[-1] + 1
    return float((low + high) / 2)


def tokens(text: str | None) -> list[str]:
    """The words of a text; a word said again and again in a row counts once."""
    return [w for w, _ in itertools.groupby(_WORD.findall(text.lower()))] if text else []


class Scorer:
    """A trained model as scoring needs it: a weight for each bucket, and the bias."""

    def __init__(self, model: SubwordModel):
        self.weights, self.bias = model.weights(), float(model.bias[1] - model.bias[0])
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [tokens(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = [w for w in set().union(*split) if w not in self.known]
        self.known.update(zip(new, word_scores(self.weights, new)))
        out = []
        for words in split:
            if not words:
                out.append(_sigmoid(self.bias))
                continue
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.known.__getitem__, words), np.float64, len(words)))])
            start = np.arange(0, max(1, len(words) - WINDOW + STEP), STEP)
            end = np.minimum(start + WINDOW, len(words))
            out.append(_sigmoid(float(((sums[end] - sums[start]) / (end - start)).max()) + self.bias))
        return out


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def held_out(doc_id: str = "doc_id"):
    """Rows that never train: crc32 of the id's text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> SubwordModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fold: those of smallest hashed id."""
    picked = (
        labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").select("text", "toxic").toLocalIterator()
    # repeated doc_ids don't lift the bound
    return SubwordModel().fit((row.text, row.toxic) for row in itertools.islice(found, rows))


def score(docs: DataFrame, model: SubwordModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability that each whole text is toxic; a column of that name is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(Scorer(model))  # of fixed size: a number for each of BUCKETS
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value
        for batch in batches:
            for a in range(0, len(batch), 128):
                part = batch.slice(a, 128)
                values = scorer.scores(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(values, pa.float64())], names=[*kept, out])

    shape = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("double").alias(out))
    return docs.mapInArrow(run, shape.schema)
