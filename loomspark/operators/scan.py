"""Questions against all notes in a fixed number of passes over what is read of the notes once.

The notes' features (token sets, lower-case text) are written once; a pass counts them and the
questions' tokens, one more finds the bounds that ``hybrid`` scales by, and one scores. All
blocks of questions go along in each pass, so the number of jobs does not grow with the
questions. A task turns each batch of its notes into matrices (tokens held, patterns found,
hashed vectors) once, multiplies them with each block's, and keeps only each question's best;
so no pair of a note and a question is ever a row, and what is shuffled is at most a few rows
for each task, question and ranker.

Rankers: ``dense`` (cosine of hashed token vectors), ``bm25`` (over token sets), ``lexical``
(weighted overlap with main and visual text, coverage, whole phrases) and ``entity``
(overlap, substrings, names, actions with speaker and text), and ``hybrid`` (half BM25, scaled
by each question's least and largest over all notes, half cosine) and ``slot`` (the answer-slot
signal of notes that share a token). Scores that are not positive rank nowhere. With each row of lexical or entity ranks go the pair's lexical score and
answer-slot signal, so that no candidate's text is joined or read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loomspark.functions import text as T
from loomspark.operators import lifecycle
from loomspark.operators import retrieval as R
from loomspark.sources import scratch

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

DIM = 64
#: Questions of a block, notes of a matrix, and rows kept beyond k where scores tie after rounding.
BLOCK, ROWS, SPARE = 512, 256, 8
SIGNALS = ("lexical_score", "answer_slot")
_TEXTS = ("visual_tokens", "speaker_tokens", "slots", "speaker", "main")
RANKERS = ("dense", "bm25", "lexical", "entity", "hybrid", "slot")


def question_features(questions: DataFrame, *more: Column) -> DataFrame:
    """What a block holds of each question. questions: query_id, query (dense), lexical_query (all other rankers)."""
    asked = F.coalesce("lexical_query", F.lit(""))
    low = F.lower(asked)
    phrases = F.filter(F.transform(F.split(low, "[,;?]+"), lambda p: F.trim(p)), lambda p: F.length(p) >= 8)
    return questions.select(
        "query_id", T.retrieval_tokens(F.col("query")).alias("dense_tokens"), T.retrieval_tokens(asked).alias("tokens"), phrases.alias("phrases"),
        F.transform(R.names(asked), F.lower).alias("names"), F.filter(F.array(*map(F.lit, R.ACTIONS)), lambda a: low.contains(a)).alias("actions"), T.slot_terms(F.col("query")).alias("slots"), *more,
    )


def note_features(notes: DataFrame, usual: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a task reads of each note, and the columns to keep; usual says whether every question sees it. notes: note_id, main, visual, speaker."""
    everyone = F.lit(True) if usual is None else usual
    split = notes.select("note_id", *keep, everyone.alias("usual"), T.retrieval_tokens(F.col("main")).alias("tokens"), T.retrieval_tokens(F.col("visual")).alias("visual_tokens"), T.retrieval_tokens(F.col("speaker")).alias("spoken"), F.lower(F.coalesce("speaker", F.lit(""))).alias("speaker"), F.lower(F.coalesce("main", F.lit(""))).alias("main"))
    return split.select("note_id", *keep, "usual", "tokens", "visual_tokens", F.array_except("spoken", "tokens").alias("speaker_tokens"), R.offered_slots(F.col("main"), F.col("tokens")).alias("slots"), "speaker", "main")


@lru_cache(maxsize=1 << 20)
def _place(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % DIM


def _vectors(lists: list[list[str]]) -> np.ndarray:
    out = np.zeros((len(lists), DIM))
    size = np.array([len(tokens) for tokens in lists], dtype=np.int64)
    np.add.at(out, (np.repeat(np.arange(len(lists)), size), [_place(t) for tokens in lists for t in tokens]), 1)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class Finder:
    """Which of some patterns a text holds."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns

    def __call__(self, text: str) -> list[int]:
        if ahocorasick is None or not self.patterns:
            return [k for k, p in enumerate(self.patterns) if p in text]
        if not hasattr(self, "machine"):
            self.machine = ahocorasick.Automaton()
            for k, p in enumerate(self.patterns):
                self.machine.add_word(p, k)
            self.machine.make_automaton()
        return list({k for _, k in self.machine.iter(text)})

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns}


def _incidence(lists: list[list[str]], places: dict[str, int]) -> np.ndarray:
    """Columns of questions, rows of tokens or patterns: how often a question lists each."""
    out = np.zeros((len(places), len(lists)))
    for k, items in enumerate(lists):
        for x in items:
            out[places[x], k] += 1
    return out


class Block:
    """A bounded block of questions as matrices; rows of a matrix are the tokens and patterns that the block asks for, among those of all questions."""

    def __init__(self, rows: list, past: bool, token: dict[str, int], pattern: dict[str, int], df: dict[str, int], n_docs: int, avgdl: float):
        self.ids, self.past = [r["query_id"] for r in rows], past
        tokens = [r["tokens"] for r in rows]
        own = {t: k for k, t in enumerate(sorted(set().union(*tokens)))}
        self.columns = np.array([token[t] for t in own], dtype=np.int64)
        self.asked = _incidence(tokens, own)
        self.n_tokens = self.asked.sum(axis=0)
        idf = np.array([np.log(1.0 + (n_docs - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in own])
        self.idf = self.asked * idf[:, None] if len(idf) else self.asked
        self.avgdl = max(avgdl, 1e-6)
        dense = [r["dense_tokens"] for r in rows]
        self.dense = _vectors(dense).T
        own = {t: k for k, t in enumerate(sorted(set().union(*dense)))}
        self.query_columns, self.query_asked = np.array([token[t] for t in own], dtype=np.int64), _incidence(dense, own)
        self.slots = _incidence([r["slots"] for r in rows], {s: k for k, s in enumerate(T.SLOT_PATTERNS)})
        found = {p: k for k, p in enumerate(sorted(_patterns(rows)))}
        self.pattern_columns = np.array([pattern[p] for p in found], dtype=np.int64)
        inside, names, actions, self.phrases = (_incidence([[p for p in items if p] for items in lists], found) for lists in (tokens, *([r[c] for r in rows] for c in ("names", "actions", "phrases"))))
        self.entity = 0.25 * inside + names + 1.5 * actions  # what a pattern that is found adds
        self.same_tokens = dense == tokens
        self.low, self.high = np.zeros(len(rows)), np.zeros(len(rows))

    def bm25(self, seen: Notes) -> np.ndarray:
        return _product(seen.held, self.columns, self.idf) * ((R.K1 + 1.0) / (1.0 + R.K1 * (1.0 - R.B + R.B * seen.size / self.avgdl)))[:, None]

    def scores(self, seen: Notes, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
        """Of each wanted ranker, and of the two signals if they are wanted, notes by questions; what a question may not see scores 0."""
        out = {}
        if "dense" in wanted or "hybrid" in wanted:
            out["dense"] = seen.vectors @ self.dense
        if "bm25" in wanted or "hybrid" in wanted:
            out["bm25"] = self.bm25(seen)
        if "hybrid" in wanted:
            out["hybrid"] = 0.5 * (out["bm25"] - self.low) / (self.high - self.low + 1e-6) + 0.5 * out["dense"]
        if {"lexical", "entity", *SIGNALS} & set(wanted):
            over, visual = _product(seen.held, self.columns, self.asked), _product(seen.visual, self.columns, self.asked)
            lexical = 3.0 * over + 0.75 * visual + (over + 0.5 * visual) / np.maximum(1.0, self.n_tokens) + 0.25 * _product(seen.whole, self.pattern_columns, self.phrases)
            entity = 2.0 * (over + _product(seen.spoken, self.columns, self.asked)) + _product(seen.found, self.pattern_columns, self.entity)
            asks = self.n_tokens > 0
            out |= {"lexical": lexical * asks, "entity": entity * asks, "lexical_score": lexical * asks}
        if {"answer_slot", "slot"} & set(wanted):
            common = over if self.same_tokens and "lexical" in out else _product(seen.held, self.query_columns, self.query_asked)
            hits = seen.slots @ self.slots
            out["answer_slot"] = np.minimum(1.0, 0.18 * np.minimum(5, common) + 0.28 * np.minimum(2, hits) + 0.10 * (seen.colon[:, None] & (hits > 0)))
            out["slot"] = out["answer_slot"] * (common > 0)
        if not self.past:
            for ranker in out:
                out[ranker] = out[ranker] * seen.usual[:, None]
        return {k: out[k] for k in wanted}


def _product(held: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """held[:, columns] @ weights over the columns that hold anything."""
    some = np.flatnonzero(held.any(axis=0)[columns])
    return held[:, columns[some]] @ weights[some]


def _patterns(rows: list) -> set[str]:
    return set().union(*(set(r[c]) for r in rows for c in ("tokens", "names", "phrases", "actions"))) - {""}


class Asked:
    """All questions: their tokens and patterns, each known by a place, and their blocks."""

    def __init__(self, rows: list, counts: dict[bool, tuple[dict[str, int], int, float]]):
        self.token = {t: k for k, t in enumerate(sorted(set().union(*(set(r["tokens"]) | set(r["dense_tokens"]) for r in rows))))}
        patterns = sorted(_patterns(rows))
        self.find = Finder(patterns)
        place = {p: k for k, p in enumerate(patterns)}
        self.is_phrase = np.zeros(len(patterns), dtype=bool)
        self.is_phrase[[place[p] for r in rows for p in r["phrases"] if p]] = True
        self.blocks = []
        for past in (False, True):
            mine = [r for r in rows if r["past"] == past]
            self.blocks += [Block(mine[a : a + BLOCK], past, self.token, place, *counts[past]) for a in range(0, len(mine), BLOCK)]
        # one matrix of notes by tokens or patterns holds 4 M numbers at most
        self.rows = max(16, min(ROWS, (4 << 20) // max(1, len(self.token), len(patterns))))

    def parts(self, batch: pa.RecordBatch, texts: bool) -> Iterator[Notes]:
        for a in range(0, len(batch), self.rows):
            if len(part := batch.slice(a, self.rows)):
                yield Notes(self, part, texts)


class Notes:
    """A few notes as matrices, in descending order of their ids, so that of equal scores the first is the larger id's."""

    def __init__(self, asked: Asked, batch: pa.RecordBatch, texts: bool):
        names = batch.schema.names
        if "note_id" in names:
            ids = batch.column(names.index("note_id")).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0), reverse=True)
            batch, self.ids = batch.take(pa.array(order)), [ids[i] for i in order]
        column = {n: batch.column(k).to_pylist() for k, n in enumerate(names)}
        self.usual = np.array(column["usual"], dtype=bool)
        self.lists = column["tokens"]
        self.size = np.array([len(t) for t in self.lists], dtype=np.float64)
        self.held = _places(self.lists, asked.token)
        if not texts:
            return
        self.visual, self.spoken = _places(column["visual_tokens"], asked.token), _places(column["speaker_tokens"], asked.token)
        self.slots = _places(column["slots"], {s: k for k, s in enumerate(T.SLOT_PATTERNS)})
        self.colon = np.array([":" in main for main in column["main"]], dtype=bool)
        self.found, self.whole = np.zeros((len(batch), len(asked.is_phrase))), np.zeros((len(batch), len(asked.is_phrase)))
        for i, (speaker, main) in enumerate(zip(column["speaker"], column["main"])):
            at = asked.find(f"{speaker} {main}")
            self.found[i, at] = 1
            self.whole[i, [k for k in at if asked.is_phrase[k] and asked.find.patterns[k] in main]] = 1

    @cached_property
    def vectors(self) -> np.ndarray:
        return _vectors(self.lists)


def _places(lists: list[list[str]], places: dict[str, int]) -> np.ndarray:
    """Rows of ones where a list holds what has a place."""
    out = np.zeros((len(lists), len(places)))
    for row, items in zip(out, lists):
        row[[k for t in items if (k := places.get(t)) is not None]] = 1
    return out


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best positive scores of each column (note, question); of equal ones the earlier row's."""
    order = np.argsort(-np.round(score, 6), axis=0, kind="stable")[:k]
    note, question = order.ravel(), np.tile(np.arange(score.shape[1]), len(order))
    keep = score[note, question] > 0
    return note[keep], question[keep]


def rank(notes: DataFrame, questions: DataFrame, depths: dict[str, int]) -> DataFrame:
    """query_id, note_id, ranker, score, lexical_score, answer_slot, rank (from 1): the best notes of each question by each ranker of depths.

    notes: note_id, main, visual, speaker; questions: query_id, query, lexical_query. By rounded score, then the larger note_id. The
    result is written; the signals are null where no ranker needs the texts.
    """
    return _rank(note_features(notes), question_features(questions).withColumn("past", F.lit(False)), depths)


def retrievable_features(notes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of the notes that some question may see, written once for all that reads them. notes: as rank() takes them, with status."""
    usual = lifecycle.is_indexable(F.col("status"))
    seen = notes.where(usual | F.col("status").isin("deprecated", "archived"))
    return scratch.materialise(note_features(seen, usual, keep), "note-features")


def rank_retrievable(notes: DataFrame, questions: DataFrame, depths: dict[str, int], held: DataFrame | None = None) -> DataFrame:
    """rank() where each question sees the notes that it may: notes have a status; questions about the past see more of them.

    held: retrievable_features of the notes, where the caller has them.
    """
    past = F.coalesce(history(F.col("query")), F.lit(False))
    asking = question_features(questions, past.alias("past"))
    if held is not None:
        return _rank(held, asking, depths, written=True)
    usual = lifecycle.is_indexable(F.col("status"))
    return _rank(note_features(notes.where(usual | F.col("status").isin("deprecated", "archived")), usual), asking, depths)


def _counts(held: DataFrame, rows: list) -> dict[bool, tuple[dict[str, int], int, float]]:
    """Of the notes that a question sees, by whether it asks for the past: how many hold each asked token, their number and mean size."""
    size, usual = F.size("tokens"), F.col("usual")
    all_, some = held.agg(F.struct(F.count(F.lit(1)), F.avg(size)), F.struct(F.count_if(usual), F.avg(F.when(usual, size)))).first()
    own = held.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rows for t in r["tokens"]})], "token string")
    tokens = held.select("usual", F.explode("tokens").alias("token")).join(F.broadcast(own), "token")  # the tokens of the questions, which the driver holds
    found = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("usual").alias("some")).collect()
    return {True: ({r["token"]: r["n"] for r in found}, all_[0], all_[1] or 0.0), False: ({r["token"]: r["some"] for r in found}, some[0], some[1] or 0.0)}


def _set_bounds(held: DataFrame, asked: Asked) -> None:
    """The least and the largest BM25 score of each question over the notes it sees: one pass over the token sets, a row for each task and question."""
    shipped = held.sparkSession.sparkContext.broadcast(asked)
    n_questions = [len(b.ids) for b in asked.blocks]
    start = np.cumsum([0, *n_questions])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(start[-1], np.inf), np.full(start[-1], -np.inf)
        for batch in batches:
            for seen in shipped.value.parts(batch, False):
                for at, block in zip(start, shipped.value.blocks):
                    score = block.bm25(seen)
                    score = score if block.past else score[seen.usual]
                    if len(score):
                        own = slice(at, at + len(block.ids))
                        low[own], high[own] = np.minimum(low[own], score.min(axis=0)), np.maximum(high[own], score.max(axis=0))
        told = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(low[told]), pa.array(high[told])], names=["q", "low", "high"])

    for row in held.select("usual", "tokens").mapInArrow(run, "q long, low double, high double").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        k = int(np.searchsorted(start, row["q"], side="right")) - 1
        asked.blocks[k].low[row["q"] - start[k]], asked.blocks[k].high[row["q"] - start[k]] = row["low"], row["high"]


def _rank(features: DataFrame, asking: DataFrame, depths: dict[str, int], written: bool = False) -> DataFrame:
    wanted = tuple(r for r in RANKERS if r in depths)
    shape = StructType([StructField("query_id", asking.schema["query_id"].dataType), StructField("note_id", features.schema["note_id"].dataType), StructField("ranker", StringType()), *[StructField(c, DoubleType()) for c in ("score", *SIGNALS)]])
    rows = list(asking.toLocalIterator())
    found, held = features.sparkSession.createDataFrame([], shape), None
    if rows:
        texts = bool({"lexical", "entity", "slot"} & set(wanted))
        features = features.select("note_id", "tokens", "usual", *(_TEXTS if texts else ()))
        held = features if written else scratch.materialise(features, "note-features")
        asked = Asked(rows, _counts(held, rows))
        if "hybrid" in wanted:
            _set_bounds(held, asked)
        shipped = held.sparkSession.sparkContext.broadcast(asked)
        found = held.mapInArrow(_scan(shipped, wanted, texts, depths, shape), shape)
    rounded = found.withColumn("score", F.round("score", 6))
    place = F.row_number().over(R.Window.partitionBy("query_id", "ranker").orderBy(F.desc("score"), F.desc("note_id")))
    limit = reduce(lambda rest, r: F.when(F.col("ranker") == r, depths[r]).otherwise(rest), wanted, F.lit(0))
    best = rounded.withColumn("rank", place).where(F.col("rank") <= limit)
    if held is None:
        return best
    done = scratch.materialise(best, "ranked")
    if not written:
        scratch.discard(held)
    return done


def _scan(shipped, wanted: tuple[str, ...], texts: bool, depths: dict[str, int], shape):
    arrow = to_arrow_schema(shape)
    told = SIGNALS if texts else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shipped.value
        best: dict[tuple[int, str], list] = {(b, r): [] for b in range(len(asked.blocks)) for r in wanted}  # (scores and signals, note ids, questions) of the notes so far
        sizes = dict.fromkeys(best, 0)
        for batch in batches:
            for seen in asked.parts(batch, texts):
                for b, block in enumerate(asked.blocks):
                    scores = block.scores(seen, (*wanted, *told))
                    for ranker in wanted:
                        note, question = _best(scores[ranker], depths[ranker] + SPARE)
                        best[b, ranker].append((np.stack([scores[k][note, question] for k in (ranker, *told)]), [seen.ids[i] for i in note.tolist()], question))
                        sizes[b, ranker] += len(note)
                        if sizes[b, ranker] > 4 * len(block.ids) * (depths[ranker] + SPARE) + 20_000:
                            best[b, ranker] = [_merge(best[b, ranker], depths[ranker] + SPARE)]
                            sizes[b, ranker] = len(best[b, ranker][0][1])
        for (b, ranker), parts in best.items():
            if parts:
                values, ids, question = _merge(parts, depths[ranker] + SPARE)
                none = [] if texts else [[None] * len(ids)] * len(SIGNALS)
                columns = [[asked.blocks[b].ids[q] for q in question.tolist()], ids, [ranker] * len(ids), *values.tolist(), *none]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run


def _merge(parts: list, k: int) -> tuple[np.ndarray, list, np.ndarray]:
    """The k best of each question among the parts, ties to the larger id."""
    values, question = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[2] for p in parts])
    score = values[0]
    ids = [i for p in parts for i in p[1]]
    names = sorted(set(ids), key=lambda i: (i is not None, i if i is not None else 0))
    place = {i: n for n, i in enumerate(names)}
    order = np.lexsort((-np.array([place[i] for i in ids], dtype=np.int64), -np.round(score, 6), question)) if ids else np.zeros(0, np.int64)
    of = question[order]
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    within = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    keep = order[within < k]
    return values[:, keep], [ids[i] for i in keep.tolist()], question[keep]


def history(query: Column) -> Column:
    """Whether a question asks for the past, so that deprecated and archived notes may answer it."""
    return lifecycle.is_retrievable(F.lit("deprecated"), query)
