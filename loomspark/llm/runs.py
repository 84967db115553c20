"""Periodic runs of words: power-of-two names, longest common extensions, grid candidates.

A run is a stretch of consecutive words with smallest period q, at least LEAST words and
three periods long, that no neighbouring word extends. Names (Karp, Miller and Rosenberg):
two blocks of 2^k words of a text have the same name exactly if they are equal; the names of
level k + 1 come from sorting pairs of names of level k, and only blocks that occur twice go
on, so ordinary text ends after a few levels. Where a run of period p lies, words p apart
agree over G = max(LEAST - p, 2p) places; so some place of a grid has a named block there
that equals the block p further on. Those candidates are extended to both sides by
descending levels. Words are names too: nothing is hashed and no suffix is sorted.

Documents are independent: one row in, one row out, no shuffle. A task's memory is bounded
by a block of documents, or by one document's words times the levels its repeats need.

Defined results: a null, empty or blank text has no words and no run; each row is judged by
itself, so repeated rows give repeated results; extra columns are kept, but for those named
like an asked-for result; a rule that plants repeats leaves rows without an id alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.llm.bpe import text_groups

#: Least words of a run, and least periods.
LEAST, PERIODS = 24, 3
#: Characters of a block of documents, and candidates that are compared at once.
BLOCK_CHARS, CANDIDATES = 1_000_000, 1 << 20

#: Start, length and period of each run, by start and then period.
Runs = list[tuple[int, int, int]]


def levels(names: np.ndarray, live: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Names and repeated places of each level: block k holds 2^k words, equal names mean equal blocks; a block that occurs once has a name of its own.

    names: of single words, with a separator of its own name after each document; live: words that occur again in their document.
    """
    out, width = [(names, live)], 1
    while len(names) > width:
        both = np.flatnonzero(live[:-width] & live[width:])
        if not len(both):
            break
        key = names[both].astype(np.int64) * np.int64(len(names) + 1) + names[both + width]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1
        if not again.any():
            break
        at = both[order[again]]
        names, live = -1 - np.arange(len(live), dtype=np.int64), np.zeros(len(live), dtype=bool)
        names[at], live[at] = group[again], True
        out.append((names, live))
        width *= 2
    return out


def find_runs(names: list[np.ndarray]) -> Runs:
    """The runs of one document, whose names of each level end with its separator."""
    n, top = len(names[0]) - 1, len(names) - 1
    # a run's repeat is shorter than 2^(top + 1) words, as no block of that many occurs twice
    periods = np.arange(1, min(n // PERIODS, 1 << top) + 1, dtype=np.int64)
    least = np.maximum(LEAST - periods, (PERIODS - 1) * periods)
    periods, least = periods[least < 1 << top + 1], least[least < 1 << top + 1]
    if not len(periods):
        return []
    level = np.floor(np.log2(np.maximum(least // 2, 1))).astype(np.int64)
    step = least - (np.int64(1) << level) + 1
    count = np.maximum(0, -(-(n - periods - (np.int64(1) << level) + 1) // step))
    table = np.stack(names)
    found: list[np.ndarray] = []
    upto = np.cumsum(count)
    at = 0
    while at < len(periods):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
        c = count[at:end]
        which = np.repeat(np.arange(at, end), c)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)) * step[which]
        same = table[level[which], place] == table[level[which], place + periods[which]]
        which, place = which[same], place[same]
        if len(which):
            found.append(_extended(table, place, periods[which]))
        at = end
    if not found:
        return []
    rows = np.concatenate(found)  # start, end, period
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, PERIODS * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # of the periods of one stretch the smallest is the run's, the others are its multiples
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return [(a, b - a, p) for a, b, p in rows.tolist()]


def _extended(table: np.ndarray, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Start, end and period of the longest stretches around places that agree with those a period further on."""
    left, right = place.copy(), place + period  # the first words to the right of which nothing is known
    for k in range(len(table) - 1, -1, -1):
        same = table[k, left] == table[k, right]
        left[same] += 1 << k
        right[same] += 1 << k
    back = place.copy()
    for k in range(len(table) - 1, -1, -1):
        far = back - (1 << k)
        same = (far >= 0) & (table[k, far] == table[k, far + period])
        back[same] -= 1 << k
    return np.unique(np.stack([back, right, period], axis=1), axis=0)


Rule = Callable[[int, int], np.ndarray | None]


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The contract's rule: for one id in ten, by its checksum, the text repeats itself from some word on; the places of the words to take."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def runs_of(texts: list[str | None], ids: list[int | None] | None = None, rule: Rule | None = None) -> Iterator[tuple[list[bytes], Runs]]:
    """Of each text its words and runs."""
    split: list[list[bytes]] = []
    parts, alive, total = [], [], 0
    for i, text in enumerate(texts):
        words = text.encode("utf-8").split() if text else []
        known: dict[bytes, int] = {}
        name = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if rule is not None and ids[i] is not None and (take := rule(ids[i], len(words))) is not None:
            words, name = [words[k] for k in take.tolist()], name[take]
        split.append(words)
        # names differ between documents, and the separator's is its own
        parts += [name + total, np.array([total + len(known)])]
        alive += [np.bincount(name, minlength=1)[name] > 1, np.zeros(1, bool)]
        total += len(known) + 1
    if not split:
        return
    named = levels(np.concatenate(parts), np.concatenate(alive))
    first_of = np.cumsum([0] + [len(w) + 1 for w in split])
    # a run's words agree with those a period further on over 16 places, so without blocks of 16 that recur there is none
    need = (LEAST - LEAST // PERIODS).bit_length() - 1
    recurs = np.concatenate([[0], np.cumsum(named[need][1])]) if len(named) > need else None
    for words, a, b in zip(split, first_of[:-1].tolist(), first_of[1:].tolist()):
        if recurs is None or recurs[b] == recurs[a]:
            yield words, []
            continue
        own = [names[a:b] for k, (names, live) in enumerate(named) if live[a:b].any()]
        yield words, find_runs(own)


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words, one blank between, without those that any run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def strongest(runs: Runs) -> tuple[int, int, int] | None:
    """The run of most periods; of equal ones the first, then that of the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


#: What detect can return, and its types.
RESULTS = {
    "runs": "array<struct<start:long,length:long,period:long>>", "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
    "runs_sha256": "string", "collapsed": "string", "collapsed_sha256": "string",
}


def _result(name: str, words: list[bytes], runs: Runs, best: tuple[int, int, int] | None):
    if name == "runs":
        return [{"start": a, "length": n, "period": p} for a, n, p in runs]
    if name == "n_runs":
        return len(runs)
    if name == "runs_sha256":
        return hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest()
    if name == "collapsed":
        return collapsed(words, runs).decode("utf-8")
    if name == "collapsed_sha256":
        return hashlib.sha256(collapsed(words, runs)).hexdigest()
    if best is None:
        return None
    return {"start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2]}[name]


def detect(docs: DataFrame, results: list[str], doc_id: str = "doc_id", text: str = "text", rule: Rule | None = None) -> DataFrame:
    """docs with the asked-for results (names of RESULTS) in place of the text: the runs, their number, the strongest one, the text without repeats, digests."""
    kept = [c for c in docs.columns if c not in results and c != text]
    inner = docs.select(*kept, *([doc_id] if doc_id not in kept else []), text)
    fields = ", ".join(f"`{c}` {t}" for c, t in [*((c, inner.schema[c].dataType.simpleString()) for c in kept), *((r, RESULTS[r]) for r in results)])
    at_id, at_text = inner.columns.index(doc_id), len(inner.columns) - 1
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(at_text).to_pylist(), batch.column(at_id).to_pylist()
            for a, b in text_groups(texts, BLOCK_CHARS):
                columns: list[list] = [[] for _ in results]
                for words, runs in runs_of(texts[a:b], ids[a:b], rule):
                    best = strongest(runs)
                    for column, name in zip(columns, results):
                        column.append(_result(name, words, runs, best))
                made = [pa.array(c, arrow.field(len(kept) + k).type) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(kept))), *made], names=[*kept, *results])

    return inner.mapInArrow(run, fields)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every text that holds a run without its repeats, words one blank apart; other texts, nulls among them, as they are."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for a, b in text_groups(texts, BLOCK_CHARS):
                new = [collapsed(words, runs).decode("utf-8") if runs else t for t, (words, runs) in zip(texts[a:b], runs_of(texts[a:b]))]
                columns = [pa.array(new, pa.string()) if k == at else batch.column(k).slice(a, b - a) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
