"""URL filters: list rules first, gradient-boosted trees on lexical features for the rest.

Features of a url are its length, depth, digit ratio, entropy, parameter counts, and two
statistics learnt from labelled urls: the log-odds of its host's suffixes (the last label,
and the last two), and the mean and largest log-odds of the character n-grams of host and
path. For the urls that train the trees these come from the other folds, so that no url's
own label reaches its features. The labelled urls are by default a reproducible set made by
a documented rule (``labelled_urls``; no table of labelled urls is at hand), or any table of
(url, label) of bounded size.

Defined results: a null url, or one without ``://``, has an empty host and path and meets no
rule; the trees judge it like any other url that no rule decides; repeated rows are each
judged; extra columns are kept, but those named as the results are replaced. A url whose
probability equals the threshold is blocked; one of any length is read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.trees import BoostedTrees

# The list's rules as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda rest, k: F.when(fits[k], values[k]).otherwise(rest), reversed(range(len(ordered))), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


#: Lexical features, before the learnt ones.
LEXICAL = 15
GRAM_BUCKETS, FOLDS, PRIOR = 1 << 17, 4, 4.0


def lexical(urls: list[str | None]) -> np.ndarray:
    """Lexical features, one row for each url."""
    return np.array([_lexical(u or "") for u in urls], dtype=np.float64).reshape(len(urls), LEXICAL)


def _parts(url: str) -> tuple[str, str, str]:
    """Host in lower case, path and query."""
    _, _, rest = url.partition("://")
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path, _, query = rest[cut:].partition("#")[0].partition("?")
    return rest[:cut].lower(), path, query


def _lexical(url: str) -> list[float]:
    host, path, query = _parts(url)
    labels = host.split(".")
    counts = np.array([host.count(c) for c in set(host)], dtype=np.float64)
    share = counts / max(len(host), 1)
    return [
        len(url),
        len(host),
        len(path),
        path.count("/"),
        len(labels),
        max(map(len, labels)),
        host.count("-"),
        sum(c.isdigit() for c in host) / max(len(host), 1),
        sum(c.isdigit() for c in path) / max(len(path), 1),
        float(-(share * np.log2(share)).sum()) if len(host) else 0.0,
        query.count("&") + 1 if query else 0,
        len(query),
        url.count("%") + url.count("@"),
        len(labels[-1]),
        float(bool(host) and host.replace(".", "").isdigit()),
    ]


def suffixes(url: str) -> tuple[str, str]:
    """The host's last label, and its last two."""
    labels = _parts(url)[0].split(".")
    return labels[-1], ".".join(labels[-2:])


def grams(url: str) -> list[int]:
    """Buckets of the distinct character n-grams of host and path, 3 to 5 long."""
    host, path, _ = _parts(url)
    text = f"^{host}{path.lower()}$"
    return list({zlib.crc32(text[i : i + n].encode("utf-8", "replace")) % GRAM_BUCKETS for n in (3, 4, 5) for i in range(len(text) - n + 1)})


class Statistics:
    """Log-odds of suffixes and n-grams among labelled urls, shrunk toward none."""

    def __init__(self, urls: list[str], labels: np.ndarray):
        totals = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=np.float64)
        ends: dict[str, np.ndarray] = {}
        counts = np.zeros((GRAM_BUCKETS, 2))
        for url, label in zip(urls, labels.tolist()):
            for end in set(suffixes(url)):
                ends.setdefault(end, np.zeros(2))[label] += 1
            counts[grams(url), label] += 1
        self.ends = {end: float(self._odds(c[None], totals)[0]) for end, c in ends.items()}
        self.grams = self._odds(counts, totals)

    @staticmethod
    def _odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        prior = PRIOR * totals / totals.sum()
        rate = (counts + prior) / (totals + PRIOR)
        return np.log(rate[:, 1] / rate[:, 0])

    def features(self, urls: list[str | None]) -> np.ndarray:
        out = np.zeros((len(urls), 4))
        for i, url in enumerate(urls):
            last, two = suffixes(url or "")
            odds = self.grams[grams(url or "")]
            out[i] = [self.ends.get(last, 0.0), self.ends.get(two, 0.0), odds.mean() if len(odds) else 0.0, np.sort(odds)[-4:].mean() if len(odds) else 0.0]
        return out


class UrlModel:
    """Learnt statistics and boosted trees over them and the lexical features."""

    def __init__(self, urls: list[str], labels: np.ndarray):
        labels = np.asarray(labels).astype(np.int64)
        fold = np.arange(len(urls)) % FOLDS
        learnt = np.zeros((len(urls), 4))
        for k in range(FOLDS):
            inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            learnt[inside] = Statistics([urls[i] for i in outside], labels[outside]).features([urls[i] for i in inside])
        x, last = np.concatenate([lexical(urls), learnt], axis=1), fold == FOLDS - 1
        self.statistics = Statistics(urls, labels)
        self.trees = BoostedTrees(trees=100, depth=5).fit(x[~last], labels[~last]).calibrate(x[last], labels[last])

    def probability(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.probability(np.concatenate([lexical(urls), self.statistics.features(urls)], axis=1))


# Fixed values of the made-up urls: what unwanted sites sell, ordinary words (some of which hold a lure inside), endings and path shapes.
LURES = (
    "pills", "viagra", "cialis", "casino", "poker", "slots", "betting", "jackpot", "lottery", "bonus", "payday", "loans", "replica", "rolex", "escort", "xxx", "adult", "hookup",
    "dating", "keto", "weightloss", "crypto", "airdrop", "doubler", "giveaway", "prize", "winner", "freegift", "coupons", "cheap", "clearance", "promo", "clickhere", "spam", "farm",
    "verify", "signin", "account-update", "secure-login", "unlock", "billing", "cracked", "keygen", "torrent", "warez", "followers", "traffic", "backlinks", "seo",
)
WORDS = (
    "apache", "alpha", "anchor", "apple", "archive", "autumn", "baker", "bank", "beacon", "between", "birch", "bridge", "brook", "build", "cabin", "campus", "canvas", "carbon",
    "castle", "cedar", "center", "city", "clear", "climate", "clinic", "cloud", "coast", "college", "community", "cooking", "copper", "cottage", "council", "craft", "crown", "culture",
    "daily", "data", "dealer", "design", "digital", "docs", "eagle", "earth", "east", "energy", "engine", "expression", "family", "farmer", "field", "film", "forest", "forum", "free",
    "freedom", "garden", "gazette", "glass", "global", "golden", "green", "guide", "harbor", "health", "heritage", "hill", "history", "home", "house", "institute", "island", "journal",
    "kitchen", "lab", "lake", "language", "law", "learning", "library", "light", "lincoln", "loan", "local", "maple", "market", "math", "meadow", "media", "metro", "mill", "mobile",
    "morning", "mountain", "museum", "music", "nature", "network", "news", "north", "observer", "ocean", "office", "open", "orchard", "park", "pillar", "pine", "planet", "poetry",
    "post", "press", "project", "public", "radio", "recipes", "research", "review", "river", "sales", "school", "science", "shop", "silver", "software", "south", "spark", "spring",
    "station", "stone", "store", "stream", "street", "studio", "summit", "sun", "teacher", "theater", "times", "tools", "town", "travel", "tree", "university", "valley", "village",
    "flower", "yellow", "overflow", "stack", "traffic", "winding", "credit", "water", "weather", "west", "wiki", "window", "winfield", "winter", "wood", "works", "world", "writer", "youth",
)
CHEAP_ENDINGS = ("xyz", "top", "click", "loan", "win", "bid", "icu", "buzz", "tk", "gq", "ml", "cf", "ru", "cn", "info", "biz")
ENDINGS = ("com", "com", "com", "org", "org", "net", "edu", "gov", "de", "fr", "es", "it", "nl", "co.uk", "ac.uk", "io", "dev", "info", "eu", "ca", "ru", "cn")
_DISGUISE = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "4", "s": "5"})


def labelled_urls(rows: int = 12_000, seed: int = 3, lures: tuple[str, ...] = LURES) -> tuple[list[str], np.ndarray]:
    """Urls with labels (1: unwanted), made by a rule.

    Both kinds are built from ordinary words, invented names, numbers and the same endings. An unwanted host or path also names a
    lure, plain, joined to words or with digits for letters, more often has hyphens, digits, cheap endings and tracking parameters, and sometimes is an
    address in numbers. Ordinary ones have the shapes of articles, repositories, wikis, shops and documents, and may hold a
    lure's letters inside a word. One url in forty lacks its scheme, whatever its label.
    """
    rng = np.random.default_rng(seed)
    syllables = ["th", "er", "on", "an", "re", "in", "ti", "es", "wh", "ou", "ble", "ha", "st", "ed", "nd", "or", "ka", "lo", "mi", "pu", "ve", "zo", "gri", "tion"]
    pick = lambda xs: str(xs[rng.integers(0, len(xs))])
    chance = lambda p: rng.random() < p
    # names of any letters, so that what no word holds speaks for neither kind
    coined = lambda: "".join(pick("bcdfghjklmnpqrstvwxyz") + pick(("", "", "l", "r", "t")) + pick("aeiouy") for _ in range(rng.integers(1, 4))) + pick(("", "n", "r", "ck", "ng", "st", "w"))
    name = lambda: pick(WORDS) if chance(0.5) else coined() if chance(0.6) else "".join(rng.choice(syllables, rng.integers(2, 5)))
    number = lambda most=99_999: str(rng.integers(1, most))
    slug = lambda: "-".join(name() for _ in range(rng.integers(1, 6)))

    def lure() -> str:
        word = pick(lures)
        return word.translate(_DISGUISE) if chance(0.2) else word + ("s" if chance(0.2) else "")

    def shape() -> str:
        kind = rng.integers(0, 10)
        if kind == 0:
            return "" if chance(0.5) else "/"
        if kind == 1:
            return f"/{rng.integers(1998, 2026)}/{rng.integers(1, 13):02d}/{slug()}" + pick(("", "/", ".html"))
        if kind == 2:
            return f"/{name()}/{name()}" + pick(("", "/issues/" + number(9000), "/blob/main/README.md", "/wiki"))
        if kind == 3:
            return "/wiki/" + "_".join(name().capitalize() for _ in range(rng.integers(1, 4)))
        if kind == 4:
            return f"/{pick(('en', 'de', 'fr', 'es', 'it'))}/{pick((name(), number()))}" + pick(("", "/", ".html"))
        if kind == 5:
            return "/" + pick(("about", "contact", "index.html", "login", "search", "products", "blog", "docs", "faq", "news", "help"))
        if kind == 6:
            return f"/{name()}/{slug()}-{number()}" + pick(("", "/"))
        if kind == 8:
            return f"/{name()}/{number(10**8)}" + pick(("", "/", "/" + slug(), "/" + slug() + "-" + number(10**8)))
        if kind == 7:
            return f"/{pick(('files', 'papers', 'images', 'static'))}/{slug()}{pick(('.pdf', '.png', '.css', '.txt'))}"
        return "/" + "/".join(name() for _ in range(rng.integers(1, 4)))

    urls, labels = [], rng.integers(0, 2, rows)
    for bad in labels:
        host = name() + (pick(("-", "")) + name() if chance(0.35) else "")
        path, ending = shape(), pick(ENDINGS)
        if bad:
            if chance(0.8):
                parts = [lure()] + [pick((name(), lure(), number(999))) for _ in range(rng.integers(0, 3))]
                rng.shuffle(parts)
                host = pick(("-", "-", "")).join(parts) + (number(9999) if chance(0.2) else "")
                path = path if chance(0.6) else f"/{lure()}" + path
            elif chance(0.3):
                host, ending = ".".join(str(rng.integers(1, 255)) for _ in range(3)), str(rng.integers(1, 255))
                path = "/" + lure() + path
            else:
                path = f"/{lure()}-{slug()}" + pick(("", "/", ".php", ".html"))
            if chance(0.4):
                ending = ending if ending.isdigit() else pick(CHEAP_ENDINGS)
        front = pick(("", "", "", "www.", "www.", "m.", "blog.", "news.", "en.", "docs.", "shop."))
        middle = pick(("", "", "", "example."))
        n = int(rng.integers(1, 4)) if chance(0.45 if bad else 0.3) else 0
        value = lambda: number(10**6) if chance(0.5) else name()
        query = "?" + "&".join(f"{pick(('id', 'page', 'q', 'ref', 'utm_source', 'lang', 'sort', 'aff', 'sid', 'v'))}={value()}" for _ in range(n)) if n else ""
        scheme = pick(("http", "https", "https")) + "://" if not chance(0.025) else ""
        urls.append(f"{scheme}{'' if ending.isdigit() else front}{host}.{'' if ending.isdigit() else middle}{ending}{path}{query}{'#' + name() if chance(0.1) else ''}")
    return urls, labels


@lru_cache(maxsize=1)
def _default() -> UrlModel:
    return UrlModel(*labelled_urls())


def train(urls: list[str] | None = None, labels: np.ndarray | None = None) -> UrlModel:
    """Fit on three quarters of the labelled urls and calibrate on the rest; the model of the made-up urls is trained once a session."""
    return _default() if urls is None else UrlModel(urls, labels)


def judge(pages: DataFrame, model: UrlModel, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score (of urls that no rule decides)."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)  # some hundreds of kB
    added = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in pages.columns if c not in added]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    prepared = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    prepared = prepared.select("*", rule.alias("rule"), verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            verdicts = column["verdict"].to_pylist()
            texts = column[url].to_pylist()
            scores: list[float | None] = [None] * len(verdicts)
            ask = [i for i, v in enumerate(verdicts) if v is None]
            for i, p in zip(ask, shipped.value.probability([texts[i] for i in ask])):
                scores[i] = float(p)
                verdicts[i] = "block" if p >= threshold else "allow"
            column |= {"verdict": pa.array(verdicts, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([column[n] for n in batch.schema.names], names=batch.schema.names)

    return prepared.mapInArrow(run, prepared.schema)
