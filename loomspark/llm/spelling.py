"""Spelling variants of a corpus's words: wildcard groups in place of pairs.

Two words are near if one inserted, deleted or replaced character parts them. A word with
one character wild is a key, the same for all words that differ there alone: a group of such
keys knows its size and its two most frequent words, and so tells each member how many near
words it has there and which is the most frequent other one. A word with one character left
out is the key under which the longer word meets the shorter one, which has the key of the
whole word. Pairs are never rows: two words that differ by a replacement meet in exactly one
group, and a group has at most as many members as the alphabet has characters (an insertion
group, as places times characters).

Words are counted by Spark over all documents, numbered in code-point order by a range sort,
and known by their numbers from then on; a key is 124 bits (four polynomials modulo primes
near 2^31), so a long word costs as many short rows as it has characters, not their product.

Defined results: a null text has no words, a null id is written as nothing; every row counts,
repeated or not; extra columns are not read. A word without near words has no form, is its
own root, and counts 0; equally frequent near words go by code-point order. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import discard, materialise

#: A word: the letters of Latin-1 (with the two signs between them), least characters, least occurrences, and how much more frequent a form is.
LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES = r"A-Za-zÀ-ÿ", 7, 2, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def long_runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of at least so many letters, A-Z lower-cased; a shorter run has no such part."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def misspelt(doc_id: Column, run: Column) -> Column:
    """The contract's rule: for one pair of id and run in 31, by its checksum, one character is left out."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule=None, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of every word that occurs often enough: one shuffle of counts, after counting in each task."""
    runs = docs.select(F.col(doc_id).alias("_id"), F.explode(long_runs(F.col(text))).alias("run"))
    word = rule(F.col("_id"), F.col("run")) if rule else F.col("run")
    counts = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


_RNG = np.random.default_rng(20250311)
_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], dtype=np.uint64)
_BASES = [int(x) for x in _RNG.integers(1 << 20, 1 << 30, 4)]
#: A value for each character of Latin-1; the last is that of the wild one.
_VALUES = _RNG.integers(1, 1 << 30, (4, 257)).astype(np.uint64)
_WILD = 256
#: Characters of words that become keys at once.
_CHUNK = 1 << 18
REPLACED, SHORTER, WHOLE = 0, 1, 2


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit halves, role and word number of each key: every place wild, every character left out (once for equal neighbours), and the whole word."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.cumsum(size) - size
    letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - start[owner]
    lanes = []
    for lane in range(4):
        prime, base = int(_PRIMES[lane]), _BASES[lane]
        p, power = np.uint64(prime), _powers(base, prime, int(size.max(initial=1)))
        own = _VALUES[lane][letters] * power[place] % p
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])  # below 2^31 times the characters of a chunk
        before = (upto[:-1] - upto[start][owner]) % p
        whole = ((upto[start + size] - upto[start]) % p).astype(np.uint64)
        after = (whole[owner] + (p << np.uint64(1)) - before - own) % p
        wild = (before + after + _VALUES[lane][_WILD] * power[place]) % p
        shorter = (before + after * np.uint64(pow(base, -1, prime))) % p
        lanes.append((wild, shorter, whole))
    once = np.ones(len(letters), dtype=bool)
    once[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    halves = []
    for a, b in ((0, 1), (2, 3)):
        joined = [lanes[a][k] << np.uint64(32) | lanes[b][k] for k in range(3)]
        halves.append(np.concatenate([joined[0], joined[1][once], joined[2]]).view(np.int64))
    role = np.repeat(np.array([REPLACED, SHORTER, WHOLE], dtype=np.int8), [len(letters), int(once.sum()), len(words)])
    return halves[0], halves[1], role, np.concatenate([owner, owner[once], np.arange(len(words))])


def wildcard_rows(numbered: DataFrame) -> DataFrame:
    """k1, k2, role, id and n: the keys of each numbered word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, words = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            size = np.cumsum([len(w) for w in words])
            a = 0
            while a < len(words):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _CHUNK, side="right")))
                k1, k2, role, of = keys(words[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(role), pa.array(ids[a:b][of]), pa.array(counts[a:b][of])], names=["k1", "k2", "role", "id", "n"])
                a = b

    return numbered.select("id", "n", "word").mapInArrow(run, "k1 long, k2 long, role byte, id long, n long")


def near_words(numbered: DataFrame) -> DataFrame:
    """id, n_near and best (n, id): how many near words each numbered word has, and the most frequent. Words without any are left out.

    Groups are bounded by the alphabet, so a window over a group's members holds few rows; the second shuffle adds up what the groups tell a word.
    """
    worth = F.struct("n", (-F.col("id")).alias("order"))  # most frequent, then first in code-point order
    rows = wildcard_rows(numbered)
    rows = rows.select("k1", "k2", "role", "id", F.when(F.col("role") != WHOLE, worth).alias("listed"), F.when(F.col("role") == WHOLE, worth).alias("own"))
    group = Window.partitionBy("k1", "k2").orderBy(F.desc_nulls_last("listed")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.withColumns({
        "size": F.count("listed").over(group), "top": F.max("listed").over(group), "second": F.nth_value("listed", 2).over(group), "whole": F.max("own").over(group),
    })
    count = F.when(F.col("role") == REPLACED, F.col("size") - 1).when(F.col("role") == SHORTER, F.when(F.col("whole").isNotNull(), 1).otherwise(0)).otherwise(F.col("size"))
    other = F.when(F.col("top.order") == -F.col("id"), F.col("second")).otherwise(F.col("top"))
    offered = F.when(F.col("role") == REPLACED, other).when(F.col("role") == SHORTER, F.col("whole")).otherwise(F.col("top"))
    found = told.select("id", count.alias("count"), offered.alias("offered")).where("count > 0")
    return found.groupBy("id").agg(F.sum("count").alias("n_near"), F.max("offered").alias("best"))


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of counted words (word, n).

    The word's most frequent near word is its form if it is so many times as frequent; forms are followed to the last one by steps
    that double until none moves: a form is so many times as frequent, so chains are short. times is over 1. What is returned is a
    materialised table, which ``discard`` deletes.
    """
    ordered = counts.repartitionByRange("word").sortWithinPartitions("word")
    numbered = materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_words(numbered).select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.order")).alias("best_id"))
    judged = numbered.join(near, "id", "left")
    has = F.col("best_n") >= times * F.col("n")
    linked = materialise(judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_id")).alias("form_id"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    links = linked.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("to"))
    steps: list[DataFrame] = []
    while True:
        further = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        steps.append(materialise(links.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "spelling-roots"))
        links = steps[-1].select("id", "to")
        if steps[-1].where("moved").isEmpty():
            break
    names = linked.select(F.col("id").alias("to"), F.col("word").alias("root"))
    roots = links.join(names, "to").select("id", "root")
    forms = linked.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    out = linked.join(roots, "id", "left").join(forms, "form_id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    done = materialise(out, "spelling-variants")
    discard(numbered, linked, *steps)
    return done

