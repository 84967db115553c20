"""Benchmark decontamination with training suffix arrays.

Each task takes its documents shard by shard (a few MB of text), turns words into
numbers of the benchmark's vocabulary, sorts the shard's suffixes, and binary-searches
every benchmark suffix in that order. The search narrows an interval of the suffix array
word by word; where it becomes empty the longest verbatim match is known, and the last
interval lists its locations. Documents are never shuffled. The only thing sent to all
executors is the benchmark's own suffixes, in blocks of a checked size.

Defined results: null and empty texts have no words and are clean; an item without words
has no windows; repeated item rows count once by id; the words of an item whose id is null
still count as hits, but it is not named or counted; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.textops import ALNUM_CLASS, row_blocks, string_buffers, word_hashes, words

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Text of benchmark items that one block of test suffixes may hold.
BLOCK_BYTES = 8 << 20

REPORT = "row long, n_words long, n_hit long, items array<string>"


class TestSuffixes:
    """Every suffix of a block of benchmark items, as numbers of the block's vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        raw, offsets = string_buffers(pa.array([t for _, t in items], pa.large_string()))
        starts, ends, rows = words(raw, offsets, ALNUM_CLASS)
        hashes = word_hashes(raw, starts, ends)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.names = [None if i is None else str(i) for i, _ in items]
        self.window = window
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.packed = max(1, 63 // self.bits)
        count = np.bincount(rows, minlength=len(items)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        self.longest = int(count.max(initial=0))
        # the items one after another, each closed by a 0, which no word has
        self.sequence = np.zeros(len(numbers) + len(items) + max(self.longest, self.packed) + 1, dtype=np.int64)
        self.sequence[np.arange(len(numbers)) + rows] = numbers + 1
        self.item = rows
        self.offset = np.arange(len(numbers)) - first[rows]
        self.start = np.arange(len(numbers)) + rows
        self.length = count[rows] - self.offset
        size = np.minimum(window, count[rows])
        self.need = np.where(self.length >= size, size, 0)  # 0: too near the item's end to begin a window
        self.keys = pack(self.sequence, self.bits, self.packed)[self.start]
        self.key_set = np.unique(self.keys)


def pack(sequence: np.ndarray, bits: int, packed: int) -> np.ndarray:
    """For each position, so many words from there in one number that sorts as they do."""
    n = len(sequence)
    out = np.zeros(n, dtype=np.int64)
    for j in range(packed):
        out <<= bits
        out[: n - j] |= sequence[j:]
    return out


def _ranks(keys: np.ndarray, width: int, depth: int) -> np.ndarray:
    """The order of all places by their first ``depth`` words, from that by ``width`` words: each round doubles the width."""
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    while width < depth:
        most = int(rank.max()) + 1
        if most == len(rank):
            break
        later = np.zeros(len(rank), dtype=np.int64)
        later[: max(0, len(rank) - width)] = rank[width:]
        rank = np.unique(rank * most + later, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank


class Tokens:
    """The words of some documents, hashed once for all blocks of tests."""

    def __init__(self, rows: np.ndarray, hashes: np.ndarray, n_rows: int):
        self.rows, self.hashes = rows, hashes
        self.n_words = np.bincount(rows, minlength=n_rows).astype(np.int64)

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Tokens:
        starts, ends, rows = words(raw, offsets, ALNUM_CLASS)
        return cls(rows, word_hashes(raw, starts, ends), len(offsets) - 1)

    def alone(self, row: int) -> Tokens:
        """One document's words, as a shard of its own."""
        a, b = np.searchsorted(self.rows, [row, row + 1])
        return Tokens(np.zeros(b - a, dtype=np.int64), self.hashes[a:b], 1)


class Shard:
    """The suffix array of some documents over a test vocabulary, in order of their first ``depth`` words."""

    def __init__(self, tokens: Tokens, tests: TestSuffixes, depth: int):
        self.n_words, rows, hashes = tokens.n_words, tokens.rows, tokens.hashes
        self.depth = min(depth, tests.longest)
        numbers = np.zeros(len(hashes), dtype=np.int64)
        if len(tests.vocabulary):
            at = np.searchsorted(tests.vocabulary, hashes)
            at[at == len(tests.vocabulary)] = 0
            numbers = np.where(tests.vocabulary[at] == hashes, at + 1, 0)
        n = len(numbers) + len(self.n_words)
        self.sequence = np.zeros(n + max(tests.longest, tests.packed) + 1, dtype=np.int64)
        place = np.arange(len(numbers)) + rows
        self.sequence[place] = numbers
        self.row = np.zeros(n, dtype=np.int64)
        self.row[place] = rows
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1]
        # suffixes that begin with no word of any item can match no test suffix
        keys = pack(self.sequence, tests.bits, tests.packed)
        entered = np.flatnonzero(self.sequence[:n])
        order = np.argsort(keys[entered], kind="stable")
        self.array = entered[order]
        self.keys = keys[self.array]
        self._deepen(keys, tests)

    def _deepen(self, keys: np.ndarray, tests: TestSuffixes) -> None:
        """Order suffixes that tie in their first words by the later ones, where any test suffix ties too."""
        if self.depth <= tests.packed or not len(self.array):
            return
        at = np.searchsorted(tests.key_set, self.keys)
        at[at == len(tests.key_set)] = 0
        tied = np.flatnonzero(tests.key_set[at] == self.keys)
        if not len(tied):
            return
        suffix = self.array[tied]
        if self.depth <= 4 * tests.packed:
            later = [keys[np.minimum(suffix + k, len(keys) - 1)] for k in range(tests.packed, self.depth, tests.packed)]
            self.array[tied] = suffix[np.lexsort([*later[::-1], self.keys[tied]])]
        else:
            rank = _ranks(keys, tests.packed, self.depth)
            self.array[tied] = suffix[np.argsort(rank[suffix], kind="stable")]

    def search(self, tests: TestSuffixes, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each test suffix: longest match in words (up to the shard's depth), its interval of the array, and the interval of its window.

        Of some suffixes only the longest matches among them are sure: one that stands, wherever it is found, behind the word before it in its item
        is followed no further, since the suffix before it matches one word more.
        """
        n = len(tests.start)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.array), np.int64)
        window_low, window_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        depth = np.zeros(n, np.int64)
        live = np.arange(n) if some is None else some
        for d in range(1, self.depth + 1):
            live = live[tests.length[live] >= d]
            if not len(live):
                break
            if d <= tests.packed:
                rest = tests.bits * (tests.packed - d)
                prefix = tests.keys[live] >> rest << rest
                lo = np.searchsorted(self.keys, prefix, side="left")
                hi = np.searchsorted(self.keys, prefix | ((1 << rest) - 1), side="right")
            else:
                want = tests.sequence[tests.start[live] + d - 1]
                lo = self._bound(low[live], high[live], want, d - 1, left=True)
                hi = self._bound(lo, high[live], want, d - 1, left=False)
            found = hi > lo
            live, lo, hi = live[found], lo[found], hi[found]
            inner = None
            if some is not None:
                after = np.minimum(live + 1, n - 1)
                follows = (tests.length[after] == tests.length[live] - 1) & (depth[after] == d - 1) & (high[after] - low[after] == hi - lo)
                inner = after[follows]
            low[live], high[live], depth[live] = lo, hi, d
            if inner is not None and len(inner):
                live = live[~np.isin(live, inner)]
            done = live[tests.need[live] == d]
            window_low[done], window_high[done] = low[done], high[done]
        high[depth == 0] = 0
        return depth, low, high, window_low, window_high

    def _bound(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, at: int, left: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            here = self.sequence[self.array[mid] + at]
            below = here < want[open_] if left else here <= want[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several intervals, and the interval each belongs to."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner], owner


class _Blocks:
    """Blocks of test suffixes on an executor; of several, one at a time is in memory."""

    def __init__(self, blocks: list):
        self.blocks = blocks

    def __iter__(self) -> Iterator[TestSuffixes]:
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > 1 and hasattr(block, "_value"):
                del block._value


def _test_blocks(benchmark: DataFrame, id_column: str, text_column: str, window: int) -> _Blocks:
    """The benchmark's suffixes in broadcast blocks of at most BLOCK_BYTES of text (or one longer item)."""
    context = benchmark.sparkSession.sparkContext
    blocks, items, size = [], [], 0
    for row in benchmark.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).toLocalIterator():
        if items and size + len(row.t or "") > BLOCK_BYTES:
            blocks.append(context.broadcast(TestSuffixes(items, window)))
            items, size = [], 0
        items.append((row.i, row.t))
        size += len(row.t or "")
    blocks.append(context.broadcast(TestSuffixes(items, window)))
    return _Blocks(blocks)


def _shards(column: pa.Array):
    raw, offsets = string_buffers(column)
    for a, b in row_blocks(offsets, SHARD_BYTES):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


#: The longest verbatim match of a document: its words, where it begins, and the item it is from.
Match = tuple[int, int, str | None]


def _longest(tests: TestSuffixes, document: Tokens, suffixes: np.ndarray) -> Match:
    """A document's longest match with some test suffixes, by the suffix array of the document alone; of equal ones the first, then the smallest item."""
    shard = Shard(document, tests, tests.longest)
    depth, low, high, _, _ = shard.search(tests, suffixes)
    best = suffixes[depth[suffixes] == depth[suffixes].max()]
    first = np.array([shard.array[low[k] : high[k]].min() for k in best])
    names = [tests.names[tests.item[k]] for k in best[first == first.min()]]
    return int(depth[best[0]]), int(first.min()), min((n for n in names if n is not None), default=None)


def _report(column: pa.Array, blocks: _Blocks, longest: bool = False) -> tuple[np.ndarray, np.ndarray, list[set[str]], list[Match | None]]:
    """Words, words hit, and items found of each document of a batch; where longest is asked for, the longest match of each that is hit."""
    n_words, n_hit = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    found: list[set[str]] = [set() for _ in range(len(column))]
    matches: list[Match | None] = [None] * len(column)
    for a, b, raw, offsets in _shards(column):
        cover, tokens = None, Tokens.of(raw, offsets)
        for tests in blocks:
            shard = Shard(tokens, tests, tests.window)  # no window is longer
            _, _, _, low, high = shard.search(tests)
            if cover is None:
                cover = np.zeros(len(shard.row) + 1, np.int32)
                n_words[a:b] = shard.n_words
            hit = np.flatnonzero(high > low)
            # items that share a window share its interval
            spans, which = np.unique(np.stack([low[hit], high[hit], tests.need[hit]]), axis=1, return_inverse=True)
            which = which.ravel()
            place, span = _spread(spans[0], spans[1])
            position = shard.array[place]
            np.add.at(cover, position, 1)
            np.add.at(cover, position + spans[2][span], -1)
            pairs = np.unique(np.stack([shard.row[position], span]), axis=1)
            of_span: dict[int, set[str]] = {}
            for k, i in zip(which, tests.item[hit]):
                if tests.names[i] is not None:
                    of_span.setdefault(int(k), set()).add(tests.names[i])
            for row, k in pairs.T:
                found[a + row] |= of_span.get(int(k), set())
            if longest and len(hit):
                by_span = np.argsort(which, kind="stable")
                ends = np.searchsorted(which[by_span], np.arange(spans.shape[1] + 1))
                rows, starts = np.unique(pairs[0], return_index=True)
                for row, own in zip(rows.tolist(), np.split(pairs[1], starts[1:])):
                    suffixes = np.sort(hit[by_span[_spread(ends[own], ends[own + 1])[0]]])
                    match = _longest(tests, tokens.alone(row), suffixes)
                    matches[a + row] = min((m for m in (matches[a + row], match) if m is not None), key=lambda m: (-m[0], m[1], m[2] is None, m[2] or ""))
        covered = np.cumsum(cover[:-1]) > 0
        n_hit[a:b] = np.bincount(shard.row[covered], minlength=b - a)
    return n_words, n_hit, found, matches


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """All columns of docs (but those named so already) with n_words, n_hit, items (sorted ids), the longest verbatim match, and contaminated.

    The longest match of a document that holds a window: n_longest words from word longest_at on (from 0), which are longest_item's; 0 and
    nulls for others. It is found in the document's own suffix array, by the test suffixes that the shard's search has found in it.
    """
    blocks = _test_blocks(benchmark, item_id, item_text, window)
    extra = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("n_longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("contaminated", pa.bool_())]
    kept = [c for c in docs.columns if c not in dict(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, found, matches = _report(batch.column(batch.schema.get_field_index(text)), blocks, longest=True)
            told = [[0 if m is None else m[0] for m in matches], [None if m is None else m[1] for m in matches], [None if m is None else m[2] for m in matches]]
            values = [n_words, n_hit, [sorted(x) for x in found], *told, n_hit > 0]
            new = [pa.array(v, kind) for v, (_, kind) in zip(values, extra)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *new], names=[*kept, *dict(extra)])

    shape = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns(
        {
            "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "n_longest": F.lit(0).cast("long"), "longest_at": F.lit(0).cast("long"),
            "longest_item": F.lit(""), "contaminated": F.lit(False),
        }
    )
    schema = shape.schema
    for field in schema.fields:
        field.nullable = True
    return docs.mapInArrow(run, schema)


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Documents without any word inside a benchmark window, with all their own columns."""
    blocks = _test_blocks(benchmark, item_id, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n_hit, _, _ = _report(batch.column(batch.schema.get_field_index(text)), blocks)
            yield batch.filter(pa.array(n_hit == 0))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", at_least: int = WINDOW
) -> DataFrame:
    """The longest verbatim match of every test suffix over all shards, with its locations.

    One row for each location: item_id (string), item_word, doc_id, doc_word, n_words. Test suffixes
    whose longest match has fewer than at_least words are left out.
    """
    blocks = _test_blocks(benchmark, item_id, item_text, WINDOW)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, _, raw, offsets in _shards(batch.column(1)):
                tokens = Tokens.of(raw, offsets)
                for tests in blocks:
                    shard = Shard(tokens, tests, tests.longest)
                    depth, low, high, _, _ = shard.search(tests)
                    keep = np.flatnonzero(depth >= at_least)
                    place, owner = _spread(low[keep], high[keep])
                    position, suffix = shard.array[place], keep[owner]
                    row = shard.row[position]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tests.names[i] for i in tests.item[suffix]], pa.string()), pa.array(tests.offset[suffix]), ids.take(pa.array(a + row)), pa.array(position - shard.first[row]), pa.array(depth[suffix])],
                        names=["item_id", "item_word", "doc_id", "doc_word", "n_words"],
                    )

    found = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"item_id string, item_word long, doc_id {id_type}, doc_word long, n_words long")
    best = found.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"))
    return found.join(best, ["item_id", "item_word", "n_words"]).select("item_id", "item_word", "doc_id", "doc_word", "n_words")


def items_digest(items: Column) -> Column:
    """Hex SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)
