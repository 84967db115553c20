"""Notes that arrive in order, each decided against all notes before it.

The write path compares a batch with the table before it; a memory that learns as it goes
needs the notes one at a time. Here a sample's notes are keyed state: a micro-batch brings
some notes of a sample, they are taken in order of arrival, each is compared with all that
the state holds, and what it does (a rewrite, a new note, edges) is in the state before the
next one is looked at. After every so many evolutions the state's index of tokens is due to
be rebuilt, which the outcome says. The state lives in the checkpoint, so a query that is
started anew goes on where it stopped; the same fold over a whole table is ``in_order``.

Rules are those of ``writepath`` and ``lifecycle``. A sample is ordered, so it is one task's
work whatever runs it; samples are independent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomspark.operators import lifecycle
from loomspark.operators.writepath import CANDIDATES, EDGES

#: Evolutions after which an index is rebuilt.
THRESHOLD = 100
SYMMETRIC = ("semantic_related", "same_topic", "same_entity", "co_used")
#: What becomes of an arriving note: the decision, the note it wrote, its edges, and the sample's counter.
OUTCOME = (
    "sample_id long, ord long, new_id string, target_id string, overlap double, action string, relation string, strength double, note_id string, content string, version int, status string, "
    "confidence double, keywords array<string>, tags array<string>, domain_paths array<string>, evidence_ids array<string>, edges array<struct<src_id:string,target_id:string,relation:string,strength:double>>, evolutions int, rebuild boolean"
)
_LISTS = ("keywords", "tags", "domain_paths")


def decide(content: str, target: str, overlap: float) -> tuple[str, str, float]:
    """lifecycle.decide for one note."""
    low, both = content.lower(), f"{target} {content}".lower()
    if any(m in low for m in lifecycle.UNCERTAIN):
        return "mark_candidate_uncertain", "semantic_related", 0.4
    if overlap < 0.08:
        return "create_separate_memory", "semantic_related", 0.6
    if overlap >= 0.16 and any(m in low for m in lifecycle.SUPERSEDING):
        return "overwrite_existing", "same_entity", 0.75
    if sum(m in both for m in lifecycle.CONDITIONAL) >= 2:
        return "refine_conditions", "same_topic", 0.7
    if overlap >= 0.16:
        return "append_detail", "elaborates", 0.65
    return "create_separate_memory", "semantic_related", 0.6


def merged(action: str, old: str, new: str) -> str:
    """lifecycle.merged_content for one note."""
    if action == "overwrite_existing":
        return new
    if action == "refine_conditions":
        return f"{old} Also, under a different condition or context, {new}"
    return old if new in old else f"{old} {new}"


class Memory:
    """One sample's notes, with an index from tokens to the notes that hold them."""

    def __init__(self, notes: dict[str, dict] | None = None, evolutions: int = 0):
        self.notes, self.evolutions = notes or {}, evolutions
        self.changed: set[str] = set()
        self.index: dict[str, set[str]] = {}
        for note_id, note in self.notes.items():
            for token in note["tokens"]:
                self.index.setdefault(token, set()).add(note_id)

    def candidates(self, tokens: list[str]) -> list[tuple[str, float]]:
        """The notes that share most with a set of tokens, by Jaccard, then age."""
        common: dict[str, int] = {}
        for token in set(tokens):
            for note_id in self.index.get(token, ()):
                common[note_id] = common.get(note_id, 0) + 1
        scored = []
        for note_id, c in common.items():
            note = self.notes[note_id]
            if note["status"] in lifecycle.INDEXABLE:
                scored.append((-round(c / (len(set(tokens)) + len(note["tokens"]) - c), 9), note["place"], note_id))
        return [(note_id, -worse) for worse, _, note_id in sorted(scored)[:CANDIDATES]]

    def add(self, row: dict) -> dict:
        """Take in one note; returns its outcome without sample and ord."""
        new_id, content, tokens = row["note_id"], row["content"] or "", list(dict.fromkeys(row["tokens"]))
        instance = (row.get("memory_level") or "instance").lower() == "instance"
        silent = instance and bool(row.get("provided"))
        found = [] if silent else self.candidates(tokens)
        target, overlap = (found[0] if found and not instance else (None, None))
        action, relation, strength = ("create_separate_memory", "semantic_related", 0.6)
        if target is not None:
            action, relation, strength = decide(content, self.notes[target]["content"], overlap)
        merging = action in lifecycle.MERGING
        if merging:
            note_id, note = target, self.notes[target]
            note["content"] = merged(action, note["content"], content)
            note["version"] += 1
            note["status"] = "active"
            note["confidence"] = min(1.0, max(note["confidence"], row["confidence"]))
            note["evidence_ids"] = list(dict.fromkeys([*note["evidence_ids"], new_id]))
            for c in _LISTS:
                note[c] = list(dict.fromkeys(x for x in [*note[c], *(row.get(c) if row.get(c) is not None else [])] if x))
            note["tokens"] = list(dict.fromkeys([*note["tokens"], *tokens])) if action != "overwrite_existing" else tokens
            for token in note["tokens"]:
                self.index.setdefault(token, set()).add(note_id)
            if action == "overwrite_existing":
                for token, holders in self.index.items():
                    if token not in tokens:
                        holders.discard(note_id)
        else:
            unsure = action == "mark_candidate_uncertain"
            note_id = new_id
            note = self.notes[new_id] = {
                "place": len(self.notes), "content": content, "tokens": tokens, "status": "candidate" if unsure else row.get("status") or "active", "version": 1,
                "confidence": min(row["confidence"], 0.4) if unsure else row["confidence"], "evidence_ids": [], **{c: list(row[c]) if row.get(c) is not None else [] for c in _LISTS},
            }
            for token in tokens:
                self.index.setdefault(token, set()).add(new_id)
        self.changed.add(note_id)
        kept = relation if relation in lifecycle.RELATIONS and relation not in lifecycle.FORBIDDEN else "semantic_related"
        edges = []
        for other in [n for n, _ in found if n != note_id][:EDGES]:
            edges.append((note_id, other, kept, strength))
            if kept in SYMMETRIC:
                edges.append((other, note_id, kept, strength))
        evolves = bool(found) if instance else merging or action == "mark_candidate_uncertain"
        self.evolutions += evolves
        return {
            "new_id": new_id, "target_id": target, "overlap": overlap, "action": action, "relation": relation, "strength": strength, "note_id": note_id, "content": note["content"], "version": note["version"],
            "status": note["status"], "confidence": note["confidence"], **{c: list(note[c]) for c in _LISTS}, "evidence_ids": list(note["evidence_ids"]), "edges": edges, "evolutions": self.evolutions,
            "rebuild": bool(evolves and self.evolutions % THRESHOLD == 0),
        }


_COLUMNS = [c.strip().split(" ")[0] for c in OUTCOME.replace("array<struct<src_id:string,target_id:string,relation:string,strength:double>>", "e").split(",")]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


class Arrivals(StatefulProcessor):
    """A sample's memory as keyed state: its notes by id, and how often it has evolved."""

    def init(self, handle) -> None:
        self.notes = handle.getMapState("notes", "note_id string", "note string")
        self.counter = handle.getValueState("evolutions", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        arrived = pd.concat(list(rows)).sort_values(["ord", "note_id"], kind="stable")
        held = {k[0]: json.loads(v[0]) for k, v in self.notes.iterator()}
        held = dict(sorted(held.items(), key=lambda item: item[1]["place"]))
        memory = Memory(held, self.counter.get()[0] if self.counter.exists() else 0)
        out = [{"sample_id": key[0], "ord": row["ord"], **memory.add(row)} for row in arrived.to_dict("records")]
        for note_id in memory.changed:
            self.notes.updateValue((note_id,), (json.dumps(memory.notes[note_id]),))
        self.counter.update((memory.evolutions,))
        yield _frame(out)

    def close(self) -> None:
        pass


def outcomes(arriving: DataFrame) -> DataFrame:
    """The outcome of each note of a stream. arriving: sample_id (long), note_id (string), ord, content, tokens, confidence, and memory_level, status, provided,
    keywords, tags, domain_paths where it has them. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    return arriving.groupBy("sample_id").transformWithStateInPandas(Arrivals(), OUTCOME, "Append", "None")


def in_order(notes: DataFrame) -> DataFrame:
    """The same outcomes for a whole table: a fold over each sample in order, batch by batch."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, memory = None, Memory()
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if row["sample_id"] != sample:
                    sample, memory = row["sample_id"], Memory()
                out.append({"sample_id": sample, "ord": row["ord"], **memory.add(row)})
            yield _frame(out)

    return notes.repartition("sample_id").sortWithinPartitions("sample_id", "ord", "note_id").mapInPandas(fold, OUTCOME)


def notes_of(outcomes_: DataFrame) -> DataFrame:
    """The notes that outcomes leave: of each the last that was written."""
    columns = ["content", "version", "status", "confidence", *_LISTS, "evidence_ids"]
    last = outcomes_.groupBy("sample_id", "note_id").agg(F.max_by(F.struct(*columns), F.struct("ord", "new_id")).alias("n"))
    return last.select("sample_id", "note_id", "n.*")


def edges_of(outcomes_: DataFrame) -> DataFrame:
    """The edges that outcomes made, each once with its largest strength."""
    rows = outcomes_.select("sample_id", F.explode("edges").alias("e")).select("sample_id", "e.*")
    return rows.groupBy("sample_id", "src_id", "target_id", "relation").agg(F.max("strength").alias("strength"))
