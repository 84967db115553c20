"""Secrets in texts: exact formats, and strings that a tokenizer finds hard to read.

Base spans (an assignment to a secret's name, an access key, a long hexadecimal run) are
always found. Beside them every maximal run of at least LEAST key characters is a candidate.
Known digests and identifiers go first: hexadecimal runs of a digest's length, UUIDs, numbers,
and names made of words and short numbers. What is left is encoded by a byte-level vocabulary: words
of a language take some four characters a token, a random string takes fewer than CHARS_PER_TOKEN, and
such strings are added as spans of kind random where they meet no base span.

Documents are independent: one row in, one row out, no shuffle. A candidate is encoded in
windows of WINDOW characters, so a run of any length is read in linear time.

Defined results: a null or empty text has no spans; each row is judged by itself, so repeated
rows give repeated results; extra columns are kept by ``redact`` and left out by ``detect``.
A candidate whose ratio equals the limit is not added.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.pii import covered, meets, redacted

# The base formats in their listed order, their least lengths, and the split rule of the vocabulary.
BASE_KINDS = ("assign", "access", "hex")
ORDER = {kind: i for i, kind in enumerate((*BASE_KINDS, "random"))}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hexadecimal characters of the digests of 128, 160, 192, 224, 256, 384 and 512 bits.
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))

#: Characters of a candidate at least, of a window, and for each token below which a candidate is random.
LEAST, WINDOW, CHARS_PER_TOKEN = 16, 256, 2.0

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_PLAIN_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
#: Words in one case, capitalised words one after another, and numbers of at most eight digits, each two joined by signs.
_NAME = re.compile(r"[-_/+=]*+(?:(?:[a-z]++|[A-Z]++|(?:[A-Z]?[a-z]{2,}+)(?:[A-Z][a-z]{2,}+)*+|[0-9]{1,8}+)(?:[-_/+=]++|\Z))++\Z")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The spans of exact format, by start and then kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(1)) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sort_spans(out)


def sort_spans(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def is_known(body: str) -> bool:
    """Whether a candidate is a digest, a UUID, a number, or a name of words and short numbers."""
    if _PLAIN_HEX.match(body) and (len(body) in DIGEST_LENGTHS or body.isdigit()):
        return True
    return bool(_UUID.match(body) or _NAME.match(body))


class Scanner:
    """Finds the secrets of texts; path is a file of ranks of a byte-level vocabulary."""

    def __init__(self, path: str, limit: float = CHARS_PER_TOKEN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.limit = limit

    def chars_per_token(self, body: str) -> float:
        """Characters for each token, each window encoded by itself."""
        return len(body) / sum(len(self.encode(body[a : a + WINDOW])) for a in range(0, len(body), WINDOW))

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """The base spans of a text, and all spans."""
        if not text:
            return [], []
        base = base_spans(text)
        taken = covered(base)
        more = []
        for m in _CANDIDATE.finditer(text):
            span = (m.start(), m.end(), "random")
            if not meets(taken, span) and not is_known(m.group()) and self.chars_per_token(m.group()) < self.limit:
                more.append(span)
        return base, sort_spans(base + more) if more else base


_SCANNERS: dict[tuple[str, float], Scanner] = {}


def scanner(path: str, limit: float = CHARS_PER_TOKEN) -> Scanner:
    """One scanner for each file, limit and worker."""
    if (path, limit) not in _SCANNERS:
        _SCANNERS[path, limit] = Scanner(path, limit)
    return _SCANNERS[path, limit]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
_STEP = 256


def detect(docs: DataFrame, path: str, limit: float = CHARS_PER_TOKEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each text: the counts and digest of its base spans, all its spans, and how many the token test added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = scanner(path, limit)
        for batch in batches:
            for a in range(0, len(batch), _STEP):
                part = batch.slice(a, _STEP)
                found = [worker.spans(t) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
                digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
                added = pa.array([len(both) - len(base) for base, both in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *counts, digests, pa.array([written(both) for _, both in found], pa.string()), added],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_random"],
                )

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, DIGEST)


def redact(docs: DataFrame, path: str, limit: float = CHARS_PER_TOKEN, text: str = "text") -> DataFrame:
    """docs with all secrets of the text replaced by their kinds; a null text stays null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = scanner(path, limit)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a in range(0, len(batch), _STEP):
                part = batch.slice(a, _STEP)
                new = [redacted(t, worker.spans(t)[1]) if t else t for t in part.column(at).to_pylist()]
                columns = [pa.array(new, pa.string()) if k == at else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
