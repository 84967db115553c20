"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a word are the leaves of a segment tree. A leaf holds the rank of the pair
that its symbol forms with the next living symbol, and its place; an inner node the smaller
of its children. The root therefore yields the leftmost pair of the lowest rank. A merge
changes two leaves and the nodes above them, and goes on until the root holds no pair.
Many words are worked on side by side: row k of each array belongs to word k, words of
like length together, so a step costs a few numpy calls for all of them. A few long words
have the same tree in plain lists, one after another, since there a numpy call is the cost.

Encoding follows the tokenizers library for the vocabulary file it is given (a BPE model
with a word-end suffix; text normalised, lower-cased and split by the file's rules).

Defined results: a null text is encoded as an empty one and has no tokens; the texts of
added tokens become their ids wherever they stand, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NO_PAIR = np.int64(2**62)
#: Words whose encoding a worker remembers, and their characters; beyond either, it starts anew.
CACHE_WORDS, CACHE_CHARS = 150_000, 3_000_000

# The white space, letters and numbers that the vocabulary's split rule names,
# below U+0250, where no text changes under canonical composition.
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x24F)
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

_WIDE = re.compile(f"[^{chr(0)}-{chr(0x24F)}]")
_WORDS = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A vocabulary file's symbols and pair ranks, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.texts = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for text, i in [*ids.items(), *self.added.items()]:
            self.texts[i] = text
        characters = byte_characters()
        self.inner = np.array([ids.get(c, -1) for c in characters], dtype=np.int64)
        self.last = np.array([ids.get(c + self.suffix, -1) for c in characters], dtype=np.int64)
        pairs, merged = [], []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append(ids[left] << 32 | ids[right])
            merged.append(ids[left + right])
        keys = np.array(pairs, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), np.array(merged, dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_PAIR where there is none; -1 stands for no symbol."""
        key = left << 32 | np.maximum(right, 0)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NO_PAIR)


def merge_words(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Apply all merges to rows of symbols, padded with -1 to a power of two; returns rows with -1 for the gone."""
    n, width = symbols.shape
    shift = max(1, width.bit_length())
    place = np.arange(width, dtype=np.int64)
    following = np.tile(place + 1, (n, 1))
    before = np.tile(place - 1, (n, 1))
    right = np.concatenate([symbols[:, 1:], np.full((n, 1), -1, np.int64)], axis=1)
    rank = vocabulary.rank(symbols.ravel(), right.ravel()).reshape(n, width)
    tree = np.full((n, 2 * width), NO_PAIR, dtype=np.int64)
    tree[:, width:] = np.where(rank < NO_PAIR, rank << shift | place, NO_PAIR)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.flatnonzero(tree[:, 1] < NO_PAIR)
    while len(live):
        top = tree[live, 1]
        at = top & ((1 << shift) - 1)
        gone = following[live, at]
        after = following[live, gone]
        symbols[live, at] = vocabulary.merged[top >> shift]
        symbols[live, gone] = -1
        following[live, at] = after
        inside = after < width
        before[live[inside], after[inside]] = at[inside]
        next_symbol = np.where(inside, symbols[live, np.minimum(after, width - 1)], -1)
        _put(tree, live, gone, np.full(len(live), NO_PAIR), width)
        rank = vocabulary.rank(symbols[live, at], next_symbol)
        _put(tree, live, at, np.where(rank < NO_PAIR, rank << shift | at, NO_PAIR), width)
        previous = before[live, at]
        has = previous >= 0
        rows, previous = live[has], previous[has]
        rank = vocabulary.rank(symbols[rows, previous], symbols[rows, at[has]])
        _put(tree, rows, previous, np.where(rank < NO_PAIR, rank << shift | previous, NO_PAIR), width)
        live = live[tree[live, 1] < NO_PAIR]
    return symbols


def _put(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, value: np.ndarray, width: int) -> None:
    """Point update of a leaf and the nodes above it."""
    node = place + width
    tree[rows, node] = value
    while width > 1:
        node = node >> 1
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        width >>= 1


#: Words of a width that is so many times their number are merged one at a time.
_FEW = 12


def merge_word(symbols: list[int], vocabulary: Vocabulary, ranks: dict[int, tuple[int, int]]) -> list[int]:
    """merge_words for one word of any length: the same tree in plain lists. ranks remembers pairs: key to rank and merged symbol."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    shift = width.bit_length()
    pairs = np.array(symbols, dtype=np.int64)
    keys = (pairs[:-1] << 32 | np.maximum(pairs[1:], 0)).tolist()
    unknown = np.array(sorted({k for k in keys if k not in ranks}), dtype=np.int64)
    _remember(unknown, vocabulary, ranks)
    none = 1 << 62
    tree = [none] * (2 * width)
    for i, key in enumerate(keys):
        rank = ranks[key][0]
        if rank < none:
            tree[width + i] = rank << shift | i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    mask = (1 << shift) - 1

    def put(place: int, value: int) -> None:
        node = place + width
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least

    def pair(place: int, right: int) -> None:
        key = symbols[place] << 32 | symbols[right]
        if key not in ranks:
            _remember(np.array([key], dtype=np.int64), vocabulary, ranks)
        rank = ranks[key][0]
        put(place, rank << shift | place if rank < none else none)

    while tree[1] < none:
        at = tree[1] & mask
        gone = following[at]
        after = following[gone]
        symbols[at] = ranks[symbols[at] << 32 | symbols[gone]][1]
        symbols[gone] = -1
        following[at] = after
        put(gone, none)
        if after < n:
            before[after] = at
            pair(at, after)
        else:
            put(at, none)
        if before[at] >= 0:
            pair(before[at], at)
    return [s for s in symbols if s >= 0]


def _remember(keys: np.ndarray, vocabulary: Vocabulary, ranks: dict[int, tuple[int, int]]) -> None:
    found = vocabulary.rank(keys >> 32, keys & 0xFFFFFFFF)
    merged = np.where(found < NO_PAIR, vocabulary.merged[np.where(found < NO_PAIR, found, 0)], -1)
    ranks.update(zip(keys.tolist(), zip(found.tolist(), merged.tolist())))


#: Cells of symbols that one call of merge_words may hold.
_CELLS = 1 << 19


def encode_words(words: list[str], vocabulary: Vocabulary) -> Iterator[tuple[str, bytes, bytes]]:
    """Of each word: itself, its token ids in bytes, and its tokens' texts with blanks between."""
    raw = [w.encode("utf-8") for w in words]
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(raw):
        by_width.setdefault(1 << max(0, len(w) - 1).bit_length(), []).append(i)
    texts = vocabulary.texts
    for width, members in by_width.items():
        if width > _FEW * len(members) and width >= 64:
            ranks: dict[int, tuple[int, int]] = {}
            for i in members:
                data = np.frombuffer(raw[i], dtype=np.uint8)
                symbols = vocabulary.inner[data]
                symbols[-1] = vocabulary.last[data[-1]]
                kept = merge_word(symbols.tolist(), vocabulary, ranks)
                yield words[i], np.array(kept, dtype="<u4").tobytes(), " ".join([texts[k] for k in kept]).encode("utf-8")
            continue
        step = max(1, _CELLS // width)
        for a in range(0, len(members), step):
            part = members[a : a + step]
            length = np.array([len(raw[i]) for i in part])
            filled = np.arange(width) < length[:, None]
            data = np.zeros((len(part), width), dtype=np.uint8)
            data[filled] = np.frombuffer(b"".join([raw[i] for i in part]), dtype=np.uint8)
            symbols = np.where(filled, vocabulary.inner[data], -1)
            rows = np.arange(len(part))
            symbols[rows, length - 1] = vocabulary.last[data[rows, length - 1]]
            symbols = merge_words(symbols, vocabulary)
            kept = symbols >= 0
            flat = symbols[kept]
            packed, tokens = flat.astype("<u4").tobytes(), [texts[i] for i in flat.tolist()]
            start = 0
            for i, end in zip(part, np.cumsum(kept.sum(axis=1)).tolist()):
                yield words[i], packed[4 * start : 4 * end], " ".join(tokens[start:end]).encode("utf-8")
                start = end


class Encoder:
    """Encodes and decodes texts; remembers the words of earlier texts up to a bound."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.rules = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t) for t in sorted(self.vocabulary.added, key=len, reverse=True)) or "(?!)")
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.chars = 0

    def _split(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if not _WIDE.search(text):
            lower = text.lower()
            if not _WIDE.search(lower):
                return _WORDS.findall(lower)
        # beyond the narrow range, classes and composition follow the library's version of Unicode
        text = self.rules.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The words of a text; an added token is one word with a leading blank, which no other word has."""
        if not self.added.search(text):
            return self._split(text)
        out, at = [], 0
        for found in self.added.finditer(text):
            out += self._split(text[at : found.start()])
            out.append(" " + found.group())
            at = found.end()
        return out + self._split(text[at:])

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered yet."""
        if len(self.ids) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.ids, self.decoded, self.chars = {}, {}, 0
        new = [w for w in words if w not in self.ids]
        self.chars += sum(map(len, new))
        plain = [w for w in new if w[0] != " "]
        for word, ids, decoded in encode_words(plain, self.vocabulary):
            self.ids[word], self.decoded[word] = ids, decoded
        for word in new:
            if word[0] == " ":
                self.ids[word] = self.vocabulary.added[word[1:]].to_bytes(4, "little")
                self.decoded[word] = word[1:].encode("utf-8")

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text: its ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        split = [self.words(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.ids.__getitem__, words)), b" ".join(map(self.decoded.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts with blanks between, as the library does for a file that names no decoder."""
        return " ".join([self.vocabulary.texts[i] for i in ids])


class SharedEncoder:
    """An encoder as a broadcast value: each worker loads it once, and drops it with its words when a task of other work comes."""

    def __init__(self, path: str):
        self.path, self.loaded = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "loaded": None}

    def get(self) -> Encoder:
        if self.loaded is None:
            self.loaded = Encoder(self.path)
        return self.loaded


#: Characters that are split and encoded together, and rows that are Python strings at once.
BATCH_CHARS, BATCH_ROWS = 2_000_000, 512


def text_groups(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


#: What encode can return, and its types.
RESULTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, results: list[str], text: str = "text") -> DataFrame:
    """docs with the asked-for results (names of RESULTS) of encoding and decoding each text; columns of such names are replaced.

    n_tokens, the ids, the text decoded from them, and SHA-256 digests: of the ids as little-endian
    unsigned 32-bit integers, and of the decoded text in UTF-8.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(SharedEncoder(path))
    kept = [c for c in docs.columns if c not in results]

    def made(pairs: list[tuple[bytes, bytes]], name: str) -> pa.Array:
        if name == "n_tokens":
            return pa.array([len(ids) // 4 for ids, _ in pairs], pa.int64())
        if name == "ids":
            ends = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids, _ in pairs])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids for ids, _ in pairs), dtype="<u4").astype(np.int32)))
        if name == "decoded":
            return pa.array([decoded.decode("utf-8") for _, decoded in pairs], pa.string())
        side = 0 if name == "ids_sha256" else 1
        return pa.array([hashlib.sha256(pair[side]).hexdigest() for pair in pairs], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shipped.value.get()
        for batch in (whole.slice(a, BATCH_ROWS) for whole in batches for a in range(0, len(whole), BATCH_ROWS)):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in text_groups(texts):
                pairs, part = list(worker.encode_batch(texts[a:b])), batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *(made(pairs, r) for r in results)], names=[*kept, *results])

    shape = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(RESULTS[r]).alias(r) for r in results])
    return docs.mapInArrow(run, shape.schema)
