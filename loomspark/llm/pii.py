"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Exact formats (email, ip, card, phone) are base spans and always found. Beside them
high-recall generators propose overlapping candidates: any run of digits with separators,
any long run of letters and digits, any address written out in words. Boosted trees judge
each candidate by its format and the words before it, and those above their kind's
calibrated threshold are added where they overlap no base span. The trees train on a
reproducible table of made-up candidates (``examples``) of documented shape.

Defined results: a null or empty text has no spans; each row is judged by itself, so
repeated rows give repeated results; extra columns are kept by ``redact`` as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.trees import BoostedTrees

# The base formats in their listed order.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the trees add, after the base ones.
ADDED_KINDS = ("secret", "number", "address")
ORDER = {kind: i for i, kind in enumerate(BASE_KINDS + ADDED_KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the possessive forms start only where a run starts, so a long run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses: from each @ with a domain, back over local characters."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        if found:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = found.end()
                out.append((start, end, "email"))
                at = text.find("@", end)
                continue
        at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of exact format, by start and then kind."""
    out = emails(text) if "@" in text else []
    if _HAS_DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = digits_of(m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sort_spans(out)


def sort_spans(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))


_NUMBER = re.compile(r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+(?![A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]?(?: at |@|\(at\)|\[at\])[\])]? ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]?(?: dot |\.|\(dot\)|\[dot\])[\])]? ?[A-Za-z]{2,24}){1,4}")
_AT = re.compile(r" at |[(\[]at[)\]]|@")


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    out: list[Span] = []
    if _HAS_DIGIT.search(text):
        out += [(m.start(), m.end(), "number") for m in _NUMBER.finditer(text)]
        out += [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text) if _HAS_DIGIT.search(m.group())]
    if (" dot " in text or "dot)" in text or "dot]" in text) and _AT.search(text):
        out += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(text) if "dot" in m.group()]
    return out


# Words before a candidate that speak for or against it.
SECRET_CUES = ("token", "secret", "key", "password", "passwd", "pwd", "api", "auth", "bearer", "credential")
PERSON_CUES = ("phone", "tel", "call", "mobile", "fax", "ssn", "social", "passport", "iban", "account", "card", "contact", "mail", "born", "id")
PLAIN_CUES = ("isbn", "version", "page", "commit", "sha", "md5", "figure", "order", "total", "sum", "doi")

FEATURES = 18


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    start, end, kind = span
    body = text[start:end]
    before = text[max(0, start - 24) : start].lower()
    n = len(body)
    digits = sum("0" <= c <= "9" for c in body)
    upper = sum("A" <= c <= "Z" for c in body)
    lower = sum("a" <= c <= "z" for c in body)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    return [
        ORDER[kind],
        min(n, 200),
        digits,
        digits / n,
        upper / n,
        lower / n,
        switches / n,
        len(set(body[:200])) / min(n, 200),
        float(all(c in "0123456789abcdefABCDEF" for c in body)),
        sum(c in " ().-/" for c in body),
        float(body[0] in "(+"),
        float(body.count("-") == 2 and n == 11),
        float(before.endswith(('"', "'", "=", ":", "= ", ": "))),
        float(any(c in before for c in SECRET_CUES)),
        float(any(c in before for c in PERSON_CUES)),
        float(any(c in before for c in PLAIN_CUES)),
        float(n >= 12 and luhn(digits_of(body))) if kind == "number" else 0.0,
        float(body.count(".")),
    ]


def examples(rows: int = 4000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Made-up candidates with labels: secrets after cues, numbers of persons, spelled-out addresses; and harmless look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: str(xs[rng.integers(0, len(xs))])
    of = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "in", "ti", "es"], rng.integers(1, 4)))
    x, y = [], []
    while len(y) < rows:
        good = bool(rng.integers(0, 2))
        lead = word() + " " + word() + " "
        kind = rng.integers(0, 3)
        if kind == 0:
            if good:
                cue = pick(*SECRET_CUES) + pick(' = "', "=", ": ", " = '", ' "')
                body = of(pick("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF"), rng.integers(20, 65))
            else:
                cue = pick("", "", "see ", "file ", "commit ", "sha ", "md5 ", "version ")
                body = pick("-".join(word() for _ in range(6)) + str(rng.integers(0, 99)), word() * 5 + str(rng.integers(0, 9)), of("0123456789abcdef", 40), of("0123456789", rng.integers(16, 30)), "/".join(word() for _ in range(5)) + "/" + str(rng.integers(0, 999)))
        elif kind == 1:
            d = lambda n: of("0123456789", n)
            if good:
                cue = pick(*PERSON_CUES) + pick(": ", " ", " no. ", "=")
                body = pick(f"{d(3)}-{d(2)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(7)}", d(10), f"+{d(2)} {d(3)} {d(4)}")
            else:
                cue = pick("", "", "", *(c + " " for c in PLAIN_CUES))
                body = pick(d(8), d(16), f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(12), f"{d(4)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}/{d(4)}")
        else:
            name, site = word(), word()
            if good:
                cue = pick("", "mail ", "contact ", "write to ")
                body = pick(f"{name} at {site} dot com", f"{name}(at){site}(dot)org", f"{name}.{word()} [at] {site} [dot] net", f"{name}{rng.integers(1, 99)} at {site} dot {pick('com', 'de', 'fr')}")
            else:
                cue = pick("", "we met ", "stand ")
                body = f"{name} at {site} dot {pick('the', 'and', 'product', 'matrix', 'notation')}"
        text = lead + cue + body
        found = [s for s in candidates(text) if s[0] >= len(lead) and s[1] > len(lead) + len(cue)]
        for span in found[:1]:
            x.append(describe(text, span))
            y.append(int(good))
    return np.array(x), np.array(y)


def covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, apart and in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def meets(stretches: tuple[list[int], list[int]], span: Span) -> bool:
    """Whether a span shares a character with any of the stretches, by binary search."""
    starts, ends = stretches
    k = bisect_right(ends, span[0])
    return k < len(starts) and starts[k] < span[1]


def chosen(found: list[tuple[float, Span]]) -> list[Span]:
    """Of overlapping candidates the likeliest; equally likely ones by place.

    Candidates that touch each other form a run, and what is chosen in one run can't meet another's;
    within a run the chosen are kept in order of place.
    """
    out: list[Span] = []
    starts: list[int] = []
    kept: list[Span] = []
    runs: list[list[tuple[float, Span]]] = []
    end = -1
    for item in sorted(found, key=lambda f: f[1][0]):
        if item[1][0] >= end:
            runs.append([])
        runs[-1].append(item)
        end = max(end, item[1][1])
    for run in runs:
        starts, kept = [], []
        for _, span in sorted(run):
            k = bisect_right(starts, span[0])
            if (k and kept[k - 1][1] > span[0]) or (k < len(kept) and kept[k][0] < span[1]):
                continue
            starts.insert(k, span[0])
            kept.insert(k, span)
        out += kept
    return out


class Detector:
    """Trees and, for each added kind, the lowest threshold at which nine of ten accepted examples are right."""

    def __init__(self, precision: float = 0.9):
        x, y = examples()
        aside = np.arange(len(y)) % 4 == 3
        self.trees = BoostedTrees(trees=50, depth=4).fit(x[~aside], y[~aside]).calibrate(x[aside], y[aside])
        p = self.trees.probability(x[aside])
        self.threshold = {}
        for kind in ADDED_KINDS:
            of_kind = x[aside][:, 0] == ORDER[kind]
            order = np.argsort(-p[of_kind], kind="stable")
            right = np.cumsum(y[aside][of_kind][order]) / np.arange(1, of_kind.sum() + 1)
            enough = np.flatnonzero(right >= precision)
            self.threshold[kind] = max(0.5, float(p[of_kind][order][enough[-1]])) if len(enough) else 1.1

    def spans(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """Of each text: the base spans, and all spans."""
        base = [base_spans(t) if t else [] for t in texts]
        owner, proposed, rows = [], [], []
        for i, text in enumerate(texts):
            taken = covered(base[i])
            for span in candidates(text) if text else []:
                if not meets(taken, span):
                    owner.append(i)
                    proposed.append(span)
                    rows.append(describe(text, span))
        out = [list(b) for b in base]
        if rows:
            p = self.trees.probability(np.array(rows))
            best: dict[int, list[tuple[float, Span]]] = {}
            for i, span, value in zip(owner, proposed, p):
                if value >= self.threshold[span[2]]:
                    best.setdefault(i, []).append((-float(value), span))
            for i, found in best.items():
                out[i] = sort_spans(out[i] + chosen(found))
        return list(zip(base, out))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_STEP = 256


def detect(docs: DataFrame, detector: Detector, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each text: the counts and digest of its base spans, and all its spans."""
    shipped = docs.sparkSession.sparkContext.broadcast(detector)  # some tens of kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), _STEP):
                part = batch.slice(a, _STEP)
                found = shipped.value.spans(part.column(1).to_pylist())
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
                digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *counts, pa.array(digests, pa.string()), pa.array([written(s) for _, s in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
                )

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, DIGEST)


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """docs with all spans of the text replaced by their kinds; a null text stays null."""
    shipped = docs.sparkSession.sparkContext.broadcast(detector)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a in range(0, len(batch), _STEP):
                part = batch.slice(a, _STEP)
                texts = part.column(at).to_pylist()
                new = [redacted(t, spans) if t else t for t, (_, spans) in zip(texts, shipped.value.spans(texts))]
                columns = [pa.array(new, pa.string()) if k == at else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
