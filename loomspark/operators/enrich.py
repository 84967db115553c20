"""Model calls as injected functions, with deterministic stand-ins where there is no model."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators.calls import CallTable, Client, Model, complete

__all__ = ["BACKENDS", "CallTable", "Client", "Model", "check", "complete", "make_client", "parse_analysis", "parse_domains", "parse_relation", "register_backend", "with_retries"]
BACKENDS: dict[str, Callable[..., Client]] = {}


def register_backend(name: str, factory: Callable[..., Client]) -> None:
    """Make a client factory known by name; it runs on the executors, once for each task."""
    BACKENDS[name.lower()] = factory


def make_client(backend: str, **options) -> Client:
    if backend.lower() not in BACKENDS:
        raise ValueError(f"no backend {backend!r}; known: {sorted(BACKENDS)}")
    return BACKENDS[backend.lower()](**options)


def with_retries(client: Client, retries: int = 2, delay: float = 1.0) -> Client:
    """Call again after failures, waiting twice as long each time; the last failure is raised."""

    def call(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return client(prompt)
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(delay * 2**attempt)
        raise AssertionError

    return call


def check(client: Client) -> bool:
    """Whether the client answers at all."""
    try:
        return bool(client("Reply with the single word READY.").strip())
    except Exception:
        return False


def parse_analysis(response, content):
    """keywords, context and tags of a response in JSON or sections; what is missing comes from the content itself."""
    clean = T.strip_fences(response)
    json = F.from_json(clean, "keywords array<string>, context string, tags array<string>", {"mode": "PERMISSIVE"})
    part = lambda name, rest: T.section(response, name, rest)
    names = ["KEYWORDS", "CONTEXT", "TAGS"]
    listed = lambda name: T.list_items(part(name, [n for n in names if n != name]))
    full = lambda a, b: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(b)
    keywords = full(full(json["keywords"], listed("KEYWORDS")), T.heuristic_keywords(content))
    said = F.coalesce(F.when(json["context"] != "", json["context"]), F.when(part("CONTEXT", ["KEYWORDS", "TAGS"]) != "", part("CONTEXT", ["KEYWORDS", "TAGS"])), T.heuristic_context(content))
    tags = full(full(json["tags"], listed("TAGS")), F.slice(keywords, 1, 3))
    return F.struct(keywords.alias("keywords"), said.alias("context"), tags.alias("tags"))


def parse_relation(response):
    """action, target, relation, confidence and reason of a response in JSON or sections."""
    clean = T.strip_fences(response)
    json = F.from_json(clean, "action string, target int, relation string, confidence string, reason string")
    names = ["ACTION", "TARGET", "RELATION", "CONFIDENCE", "REASON"]
    part = lambda name: F.nullif(T.section(response, name, [n for n in names if n != name]), F.lit(""))
    target = F.coalesce(json["target"], F.regexp_extract(F.coalesce(part("TARGET"), F.lit("")), r"(\d+)", 1).try_cast("int"))
    return F.struct(
        F.lower(F.coalesce(json["action"], part("ACTION"))).alias("action"), target.alias("target"), F.lower(F.coalesce(json["relation"], part("RELATION"))).alias("relation"),
        T.clamp_confidence(F.coalesce(json["confidence"], part("CONFIDENCE")), 0.6).alias("confidence"), F.coalesce(json["reason"], part("REASON"), F.lit("")).alias("reason"),
    )


def parse_domains(response, valid):
    """Valid domains that a rerank response names, in its order; all valid ones where it names none."""
    json = F.from_json(T.strip_fences(response), "domains array<string>")
    said = F.coalesce(json["domains"], T.list_items(T.section(response, "DOMAINS", ["REASON"])))
    kept = F.array_distinct(F.filter(F.transform(said, T.normalize_domain), lambda d: F.array_contains(valid, d)))
    return F.when(F.size(kept) > 0, kept).otherwise(valid)
