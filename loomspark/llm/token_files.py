"""Token ids in ORC files: run-length coded integers, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id, sorted within, encoded and written as one ORC
file each: ids as array<int> (integer run-length encoding), an index entry every so many
rows with minimum and maximum of doc_id, and a Bloom filter on it. A file and its stripes can
be read by themselves; a lookup of one document skips all stripes whose statistics or filter
rule it out. Each row also holds its shard and the number of ids before it in the shard, so
a document's global start needs only the shards' totals.

The tokenizers library encodes. Byte-level BPE never merges across a blank that follows a
visible character, so a text is cut there and each distinct word is encoded once per worker.

Defined results: null texts are encoded as empty ones (only the end id); rows without a
doc_id come first; rows that repeat a doc_id follow each other, ordered by text; extra
columns are left out, whatever their names. Rows without a doc_id are divided among shards at
random. An empty table gives files without rows, or none.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

END_ID = 0
#: Words and pieces of words whose ids a worker remembers; beyond it, it starts anew.
CACHE_WORDS, CACHE_PIECES = 500_000, 700_000
ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20

# The white space, letters and numbers of the vocabulary's split rule below U+0250.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-" + chr(0x24F)
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_WIDE = f"[^{chr(0)}-{chr(0x24F)}]"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PARTING = re.compile(r"(?<=\S) (?=\S)")


class _Odd(Exception):
    """A word that is empty or touches white space: the blank before or after it parts nothing."""


class _Words(dict):
    """The ids of words with a blank before them; a word that is new is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        ids = self[word] = self.encode(" " + word)
        return ids


class PieceEncoder:
    """Ids of texts by the library, remembered by the words between blanks and by the pieces of words.

    A text is cut before blanks that stand between visible characters. A word that is new is
    cut by the vocabulary's rule, and the library's model merges each piece that is new; words
    beyond the rule's narrow range, or with an added token, go through the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Finds what only the library's own rules read right; ASCII words without the tokens' first characters hold none of it.
        self.whole = re.compile("|".join([_WIDE, *map(re.escape, added)])).search
        self.begins = re.compile("[" + re.escape("".join({t[0] for t in added})) + "]").search if added else lambda _: None
        #: Whether ASCII letters, blanks, commas and full stops begin no added token.
        self.simple = not any(t[0].isalpha() or t[0] in " .," for t in added)
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(0x100, 0x200))
        #: The character that the model reads for each byte.
        self.characters = {b: b if b in plain else next(spare) for b in range(256)}
        self.blank = chr(self.characters[0x20])
        self.words = _Words(self._encode)
        self.pieces: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers, the end id last."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        end, known = END_ID.to_bytes(4, "little"), self.words.__getitem__
        out = []
        for text in texts:
            if not text:
                out.append(end)
                continue
            parts = text.split(" ")
            parts[0], rest = "", parts[0]  # the text's first word has no blank before it
            try:
                ids = b"".join(map(known, itertools.islice(parts, 1, None)))
            except _Odd:
                # blanks beside white space: only those between visible characters part words
                cuts = [0, *(m.start() for m in _PARTING.finditer(text)), len(text)]
                rest, ids = text[: cuts[1]], b"".join([self._encode(text[a:b]) for a, b in zip(cuts[1:], cuts[2:])])
            out.append(self._encode(rest) + ids + end)
        return out

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        known = self.pieces.get
        if (whole := known(text)) is not None:
            return whole
        ascii_ = text.isascii()
        if ascii_ and self.simple:  # most words need no rule: letters, and perhaps a mark after them
            word = text[1:] if text[0] == " " else text
            if word.isalpha():
                return self._merged(text, True)
            if word[-1:] in ".," and word[:-1].isalpha():
                letters, mark = text[:-1], text[-1]
                return (known(letters) or self._merged(letters, True)) + (known(mark) or self._merged(mark, True))
        if (not ascii_ or self.begins(text)) and self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out = [known(piece) or self._merged(piece, ascii_) for piece in _PIECES.findall(text)]
        return b"".join(out) if len(out) > 1 else out[0]

    def _merged(self, piece: str, ascii_: bool) -> bytes:
        """The ids of a new piece, by the library's model."""
        read = piece.replace(" ", self.blank) if ascii_ and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.characters)
        made = [t.id for t in self.model.tokenize(read)]
        ids = self.pieces[piece] = struct.pack(f"<{len(made)}I", *made)
        return ids


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _groups(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """Encode every text and write the ORC files, in ascending order of doc_id over the files' shards.

    There are as many files as shuffle partitions, or as files says.
    """
    parts = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # rows without an id would all lie in one range: chance divides them
    dealt = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.rand(7))).repartitionByRange(parts, F.col("doc_id"), F.col("spread")).drop("spread")
    ordered = dealt.sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, before = _encoder(tokenizer), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts, 1_000_000):
                ids = worker.encode_batch(texts[a:b])
                count = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(count)
                flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(before + ends - count), pa.array(count), lists],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                before += int(count.sum())

    encoded = ordered.mapInArrow(run, "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>")
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.create.index", "true")
        .option("compression", "snappy")
        .orc(folder)
    )


SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows with ``start``: the number of ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    totals = rows.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("total"))
    # one row for each file that write() has dealt out: a running sum over the files
    offsets = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("offset"))
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; stripes that cannot hold them are not read."""
    return spark.read.schema(SCHEMA).orc(folder).where(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "n_tokens", "ids")


def ids_crc32(df: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy()))
            data = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(sums, pa.int64())], names=[*keep, "ids_crc32"])

    chosen = df.select(*keep, "ids")
    return chosen.mapInArrow(run, chosen.drop("ids").withColumn("ids_crc32", F.lit(0).cast("long")).schema)

