"""Model responses as Column expressions: JSON where there is some, else sections, else a defined default.

A null response is read as an empty one everywhere.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import lifecycle

# What decisions and levels may be.
EVOLUTIONS = ["NO_EVOLUTION", "STRENGTHEN", "UPDATE_NEIGHBOR", "STRENGTHEN_AND_UPDATE"]
RESOLVED = ["semantic_related", "same_topic", "same_entity", "evidence_for", "generalizes", "elaborates", "co_used", "none"]
LEVELS = ["instance", "task", "generalized"]
# What an answer of each type has to look like.
INSTRUCTIONS = {
    "temporal": "Return only the date, relative date, duration, or approximate time. Use the conversation date when resolving words like yesterday, last week, or next month.",
    "count": "Return only the number or short count phrase.",
    "yes_no_judgment": "Return Likely yes or Likely no, followed by a very short evidence phrase when available. Example style: Likely yes; classic children's books. Do not write a full explanation.",
    "trait_or_preference": "Return the trait, field, preference, belief, or category phrase, optionally followed by a very short evidence anchor. Do not write a full explanation.",
    "list": "Return a comma-separated list of all distinct supported items. Do not include unsupported items or explanations.",
    "yes_no_fact": "Return only Yes or No, optionally followed by a 2-5 word factual qualifier.",
    "person": "Return only the person or group names.",
    "place": "Return only the place, country, or location phrase.",
    "factual_span": "Return the shortest factual answer phrase supported by the evidence. If a relevant memory mentions the subject, object, event, or activity asked about, answer with the closest supported phrase.",
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strict_fences(response: Column) -> Column:
    """A response without the fences around it; fences inside stay, unlike with T.strip_fences."""
    bare = F.regexp_replace(_text(response), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(bare, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(bare)


def json_object(response: Column) -> Column:
    """The JSON object that a response is, or that stands between its first and last brace, as text; {} if there is none."""
    clean = strict_fences(response)
    inside = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object(clean), clean).when((inside != "") & is_object(inside), inside).otherwise(F.lit("{}"))


def whole_json(response: Column, schema: str) -> Column:
    """The response read by a schema; null where it isn't a JSON object."""
    clean = T.strip_fences(response)
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(clean)).startswith("OBJECT"), F.lit(False)), F.from_json(clean, schema))


def _section(response: Column, name: str, names: list[str]) -> Column:
    return T.section(response, name, [n for n in names if n != name])


def _code(c: Column) -> Column:
    """Lower case with blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")


def evolution(response: Column) -> Column:
    """decision and reason of whether neighbours change."""
    said = whole_json(response, "should_evolve boolean, actions array<string>, decision string, reason string")
    names = ["DECISION", "REASON"]
    told = F.replace(F.upper(F.trim(_section(response, "DECISION", names))), F.lit(" "), F.lit("_"))
    high = F.upper(_text(response))
    guess = F.when(high.contains("STRENGTHEN") & high.contains("UPDATE"), "STRENGTHEN_AND_UPDATE").when(high.contains("STRENGTHEN"), "STRENGTHEN").when(high.contains("UPDATE"), "UPDATE_NEIGHBOR").otherwise("NO_EVOLUTION")
    has = lambda a: F.coalesce(F.array_contains(said["actions"], a), F.lit(False))
    acts = F.when(has("strengthen") & has("update_neighbor"), "STRENGTHEN_AND_UPDATE").when(has("strengthen"), "STRENGTHEN").when(has("update_neighbor"), "UPDATE_NEIGHBOR").otherwise("NO_EVOLUTION")
    sections = F.struct(F.when(told.isin(EVOLUTIONS), told).otherwise(guess).alias("decision"), F.trim(_section(response, "REASON", names)).alias("reason"))
    flagged = F.struct(F.when(said["should_evolve"], acts).otherwise("NO_EVOLUTION").alias("decision"), F.lit("").alias("reason"))
    plain = F.struct(F.coalesce(said["decision"], F.lit("NO_EVOLUTION")).alias("decision"), F.coalesce(said["reason"], F.lit("")).alias("reason"))
    return F.when(said.isNull(), sections).when(said["should_evolve"].isNotNull(), flagged).otherwise(plain)


def strengthen(response: Column) -> Column:
    """connections (numbers) and tags to add."""
    said = whole_json(response, "connections array<int>, suggested_connections array<int>, tags array<string>, tags_to_update array<string>")
    names = ["CONNECTIONS", "TAGS"]
    numbers = F.array_compact(F.transform(T.list_items(_section(response, "CONNECTIONS", names)), lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("int"))))
    none = lambda t: F.array().cast(f"array<{t}>")
    return F.struct(
        F.when(said.isNull(), numbers).otherwise(F.coalesce(said["connections"], said["suggested_connections"], none("int"))).alias("connections"),
        F.when(said.isNull(), T.list_items(_section(response, "TAGS", names))).otherwise(F.coalesce(said["tags"], said["tags_to_update"], none("string"))).alias("tags"),
    )


def neighbours(response: Column, n: int) -> Column:
    """context and tags for each of n neighbours; what a response leaves out is empty."""
    said = whole_json(response, "new_context_neighborhood array<string>, new_tags_neighborhood array<array<string>>")
    none = F.array().cast("array<string>")

    def one(i: int) -> Column:
        block = F.regexp_extract(_text(response), rf"(?is)NEIGHBOR\s+{i}\s*:(.*?)(?=NEIGHBOR\s+{i + 1}\s*:|\z)", 1)
        listed = F.struct(F.trim(_section(block, "CONTEXT", ["CONTEXT", "TAGS"])).alias("context"), T.list_items(_section(block, "TAGS", ["CONTEXT", "TAGS"])).alias("tags"))
        given = F.struct(F.coalesce(F.get(said["new_context_neighborhood"], i), F.lit("")).alias("context"), F.coalesce(F.get(said["new_tags_neighborhood"], i), none).alias("tags"))
        return F.when(said.isNull(), listed).otherwise(given)

    return F.array(*[one(i) for i in range(n)])


def relation(response: Column) -> Column:
    """action, target, relation, confidence and reason of a write-time decision, everything out of range replaced."""
    said = whole_json(response, "action string, target string, relation string, confidence string, reason string")
    names = ["ACTION", "TARGET", "RELATION", "CONFIDENCE", "REASON"]
    part = lambda n: F.when(said.isNull(), _section(response, n, names)).otherwise(said[n.lower()])
    target = F.when(F.upper(F.trim(part("TARGET"))) != "NONE", F.regexp_extract(_text(part("TARGET")), r"-?\d+", 0).try_cast("int"))
    return F.struct(
        lifecycle.one_of(_code(_text(part("ACTION"))), lifecycle.ACTIONS, "create_separate_memory").alias("action"), target.alias("target"),
        lifecycle.one_of(_code(_text(part("RELATION"))), RESOLVED, "semantic_related").alias("relation"), T.clamp_confidence(part("CONFIDENCE"), 0.6).alias("confidence"), F.trim(_text(part("REASON"))).alias("reason"),
    )


def rewrite(response: Column) -> Column:
    """content, conditions, domain_paths, memory_level, confidence and update_reason of a rewritten note."""
    said = whole_json(response, "content string, conditions array<map<string,string>>, domain_paths array<string>, memory_level string, confidence string, update_reason string")
    names = ["CONTENT", "CONDITIONS", "DOMAIN_PATHS", "MEMORY_LEVEL", "CONFIDENCE", "UPDATE_REASON"]
    part = lambda n: F.when(said.isNull(), _section(response, n, names)).otherwise(said[n.lower()])
    lines = F.transform(F.split(_section(response, "CONDITIONS", names), r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"^[-*•]\s*", ""))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.regexp_replace(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))), " ", "_").alias("k"), F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("v")))
    # a line "context: ..." begins a new condition; of a key that a condition names again the last value counts
    step = F.aggregate(
        pairs, F.array().cast("array<map<string,string>>"),
        lambda done, p: F.when((F.size(done) == 0) | (p["k"] == "context"), F.concat(done, F.array(F.create_map(p["k"], p["v"])))).otherwise(
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.map_concat(F.map_filter(F.element_at(done, -1), lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"]))))
        ),
    )
    none = lambda t: F.array().cast(t)
    return F.struct(
        F.trim(_text(part("CONTENT"))).alias("content"),
        F.when(said.isNull(), step).otherwise(F.coalesce(F.filter(said["conditions"], lambda c: c.isNotNull() & (F.size(c) > 0)), none("array<map<string,string>>"))).alias("conditions"),
        F.when(said.isNull(), T.list_items(_section(response, "DOMAIN_PATHS", names))).otherwise(F.coalesce(said["domain_paths"], none("array<string>"))).alias("domain_paths"),
        lifecycle.one_of(F.lower(F.trim(_text(part("MEMORY_LEVEL")))), LEVELS, "instance").alias("memory_level"), T.clamp_confidence(part("CONFIDENCE"), 0.8).alias("confidence"), F.trim(_text(part("UPDATE_REASON"))).alias("update_reason"),
    )


def domain_rerank(response: Column, valid: Column, most: int = 3) -> Column:
    """domains (valid ones that the response names in any case, in its order, most at most; else the first valid one) and reason."""
    said = whole_json(response, "domains array<string>, reason string")
    listed = F.when(said.isNull(), T.list_items(_section(response, "DOMAINS", ["DOMAINS", "REASON"]))).otherwise(F.coalesce(said["domains"], F.array().cast("array<string>")))
    matched = F.array_compact(F.transform(listed, lambda d: F.try_element_at(F.filter(valid, lambda v: F.lower(v) == F.lower(F.trim(d))), F.lit(1))))
    chosen = F.slice(F.array_distinct(matched), 1, most)
    reason = F.trim(_text(F.when(said.isNull(), _section(response, "REASON", ["DOMAINS", "REASON"])).otherwise(said["reason"])))
    return F.struct(F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(valid, 1, 1)).alias("domains"), reason.alias("reason"))


def plain_field(response: Column, field: str) -> Column:
    """One field of a JSON response as text, else the response itself, trimmed. Serves answers and relevant parts."""
    parsed = F.try_parse_json(T.strip_fences(response))
    return F.coalesce(F.try_variant_get(parsed, f"$.{field}", "string"), F.regexp_replace(_text(response), r"^\s+|\s+$", ""))


def answer(response: Column) -> Column:
    return plain_field(response, "answer")


def relevant_parts(response: Column) -> Column:
    return plain_field(response, "relevant_parts")


def keyword_line(response: Column) -> Column:
    """Keywords of a question: a JSON field, a section, or the response."""
    said = plain_field(response, "keywords")
    listed = T.section(response, "KEYWORDS", [])
    return F.when(listed != "", listed).otherwise(said)


def typed_empty(schema: str) -> str:
    """The JSON object with an empty value of each property's type, for a JSON schema given as text."""
    empty = {"array": [], "string": "", "object": {}, "number": 0, "integer": 0, "boolean": False}
    properties = json.loads(schema).get("json_schema", {}).get("schema", {}).get("properties", {})
    return json.dumps({name: empty.get(p.get("type")) for name, p in properties.items()})


def instruction(answer_type: Column) -> Column:
    """How an answer of a type has to look."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair]), answer_type), F.lit(INSTRUCTIONS["factual_span"]))


def context_blocks(context: Column) -> Column:
    """date and content of each note in a formatted context, in order."""
    pattern = F.lit(r"(?s)talk start time:(.*?) memory content: (.*?)(?= relation: .*?talk start time:|talk start time:|\z)")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    found = F.arrays_zip(F.regexp_extract_all(_text(context), pattern, F.lit(1)).alias("d"), F.regexp_extract_all(_text(context), pattern, F.lit(2)).alias("c"))
    return F.transform(found, lambda b: F.struct(strip(b["d"]).alias("date"), strip(b["c"]).alias("content")))


def relation_names(context: Column) -> Column:
    """The relation of each block of a formatted context."""
    return F.regexp_extract_all(_text(context), F.lit(r"relation:\s*([a-zA-Z_]+)"), F.lit(1))


def context_block(date: Column, content: Column, relation_: Column | None = None, reason: Column | None = None) -> Column:
    """One note as it stands in a context."""
    lead = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(name), c, F.lit(" "))) for name, c in (("relation: ", relation_), ("edge reason: ", reason)) if c is not None]
    return F.concat(F.concat_ws("", *lead) if lead else F.lit(""), F.lit("talk start time:"), _text(date), F.lit(" memory content: "), _text(content), F.lit("\n"))


def inferred_domains(category: Column, tags: Column) -> Column:
    """Category and first three tags, each once; General if there are none."""
    own = F.when(F.coalesce(category, F.lit("")).isin("", "Uncategorized"), F.array().cast("array<string>")).otherwise(F.array(category))
    named = F.filter(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 3), lambda t: t.isNotNull() & (t != ""))
    both = F.array_distinct(F.concat(own, named))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("General")))


def event_text(speaker: Column, text: Column, caption: Column, query: Column) -> Column:
    return F.trim(F.concat(*[x for c in (speaker, text, caption, query) for x in (_text(c), F.lit(" "))]))


def brief(dia_id: Column, date: Column, speaker: Column, text: Column, most: int = 220) -> Column:
    """A note in one line, cut at most characters: a format of the overview and of prompts."""
    return F.substring(F.concat_ws(" | ", *[F.when(c != "", c) for c in (dia_id, date, speaker, text)]), 1, most)


def note_dia_id(conditions: Column, content: Column) -> Column:
    """A note's turn id: the first valid one among its conditions, else the first in its content."""
    valid = F.filter(F.transform(F.coalesce(conditions, F.array().cast("array<map<string,string>>")), lambda c: F.element_at(c, "dia_id")), lambda d: d.rlike(r"^D\d+:\d+$"))
    return F.coalesce(F.try_element_at(valid, F.lit(1)), F.try_element_at(T.dia_ids(content), F.lit(1)))


def baseline_text(content: Column, context: Column, keywords: Column, tags: Column, added: bool) -> Column:
    """A note as the plain index holds it: one form when it is added, another when the index is rebuilt."""
    join = lambda c, s: F.array_join(F.coalesce(c, F.array().cast("array<string>")), s)
    if added:
        return F.concat(F.lit("content:"), _text(content), F.lit(" context:"), _text(context), F.lit(" keywords: "), join(keywords, ", "), F.lit(" tags: "), join(tags, ", "))
    return F.concat(_text(content), F.lit(" , "), _text(context), F.lit(" "), join(keywords, " "), F.lit(" "), join(tags, " "))


def word_tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


