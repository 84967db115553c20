"""Tokenisers, field parsers and rule classifiers as Column expressions: no Python runs on executors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the retrieval and overlap tokenisers.
RETRIEVAL_STOP = [
    "the", "and", "for", "with", "that", "this", "from", "into", "what", "when", "where", "which", "would", "could", "should", "about", "mention", "mentioned",
    "conversation", "answer", "short", "date", "time", "last", "week", "year", "month", "yesterday", "today", "tomorrow", "before", "after", "did", "does",
    "was", "were", "has", "have", "had", "their", "they", "them", "his", "her", "him", "she", "you", "your", "are", "any", "all", "who", "why", "how",
]
OVERLAP_STOP = [
    "the", "and", "for", "with", "that", "this", "from", "into", "what", "when", "where", "which", "would", "could", "should", "about", "mention", "mentioned",
    "conversation", "answer", "short", "date", "time", "last", "week", "year", "month", "yesterday", "today", "tomorrow", "before", "after", "did", "does",
    "was", "were", "has", "have", "had", "her", "his", "their", "they", "she", "him", "caroline", "melanie",
]
# Word lists of the note tokens and of the keyword rule.
MEMORY_STOP = ["the", "and", "for", "that", "this", "with", "from", "into", "speaker", "says", "said", "user", "about", "would", "could", "should", "have"]
KEYWORD_STOP = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "just", "because", "but", "and", "or", "if", "while", "about", "up", "it", "its", "i", "me", "my", "you", "your", "he", "she", "they", "we", "this",
    "that", "these", "those", "what", "which", "who", "whom", "says", "said", "speaker",
]
NOTE_FIELDS = ("dia_id", "session_date", "speaker", "content", "image_caption", "image_query")
DEFAULT_DOMAIN = "General / Conversation / Episodic"

# Answer slots and the pattern that asks for each.
SLOT_PATTERNS = {
    "activity": r"\bactivit|partake|destress|hikes?|camp|paint|pottery|swim|run|family\b",
    "event": r"\bevents?|participat|attended|community|conference|meeting|group|parade|speech|fundraiser\b",
    "place": r"\bwhere|places?|cities?|countries?|beach|park|trail|museum|visited|moved\b",
    "person": r"\bwho|people|person|support|supports|friend|mentor|family|children|kids\b",
    "support source": r"\bsupport|supports|helped|negative experience\b",
    "object item": r"\bitems?|objects?|symbols?|instrument|shoes|necklace|tattoo|pottery\b",
    "book media": r"\bbooks?|read|novel|suggestion|recommended|media\b",
    "art subject": r"\bpaint|painting|art|subject|make\b",
    "music artist band": r"\bmusical artists?|bands?|concert|music|seen\b",
    "pet name": r"\bpets?|names?|dog|cat\b",
    "identity status": r"\bidentity|status|transition|transgender|relationship status\b",
    "career goal": r"\bcareer|goal|work|business|venture|studio|path\b",
    "count fact": r"\bhow many|number of|count\b",
    "temporal fact": r"\bwhen|how long|date|time|year|month|week\b",
    "preference trait": r"\bprefer|preference|trait|interested|likes?|would\b",
}
# Evidence cues that a question's wording adds, in order.
EXPANSIONS = [
    (r"\bidentity\b|\btransgender\b|\btransition", ["transgender", "trans", "transition", "coming out", "womanhood", "gender identity"]),
    (r"relationship status|\bsingle parent\b|\bbreakup\b", ["single parent", "breakup", "support", "friends", "family"]),
    (r"career path|\bcounsel|mental health|therap", ["counseling", "mental health", "therapeutic", "workshop", "support"]),
    (r"\bmove from\b|\bmoved from\b|\bhome country\b|\broots\b", ["home country", "Sweden", "roots", "grandma", "necklace"]),
    (r"\bactivit|partake|destress|family|hikes?\b", ["pottery", "swimming", "camping", "hiking", "running", "painting", "frisbee", "family"]),
    (r"\bkids?\b|\bchildren\b", ["kids", "children", "nature", "dinosaur", "animals", "exhibit", "family"]),
    (r"\bevents?\b|\bparticipat|community|lgbtq|transgender-specific\b", ["support group", "pride parade", "school event", "workshop", "fundraiser", "community"]),
    (r"\bpaint|painting|painted|art\b", ["painting", "painted", "artwork", "sunset", "lake", "portrait", "subject"]),
    (r"\bpottery\b", ["pottery", "class", "clay", "kids", "made"]),
    (r"\bpets?\b|\bnames?\b", ["pets", "names", "dog", "cat"]),
    (r"\bmusical artists?\b|\bbands?\b|\bconcert\b", ["music", "concert", "artist", "band", "saw"]),
    (r"\bbook\b|\bread\b|\bsuggestion\b", ["book", "read", "suggestion", "recommended", "novel"]),
    (r"\bbeach\b", ["beach", "trip", "went", "2023"]),
]
# Ordered question classifiers.
ANSWER_TYPES = [
    (r"\bwhen\b|\bhow long ago\b|\bwhat date\b|\bwhich day\b", "temporal"),
    (r"\bhow many\b|\bnumber of\b|\bhow often\b", "count"),
    (r"\bpersonality traits?\b|\bpolitical leaning\b|\bfields? would\b|\bmore interested\b", "trait_or_preference"),
    (r"\bwhat would\b.*\blikely be\b|\bwhat .* might\b", "trait_or_preference"),
    (r"\bwould\b|\blikely\b|\bmight\b|\bconsidered\b", "yes_no_judgment"),
    (r"\bwhat (?:activities|events|books|items|types|ways|symbols|changes|musical artists|bands)\b|\bwhich (?:classical musicians|musical artists|bands)\b|\bin what ways\b", "list"),
    (r"^(did|does|do|is|are|was|were|has|have|had|can|could)\b", "yes_no_fact"),
    (r"\bwho\b", "person"),
    (r"\bwhere\b|\bwhat country\b", "place"),
]
# The pattern of each kind of slot, and the two orders in which the two places that classify try them.
SLOT_TYPE_PATTERNS = {
    "count": r"\bhow many\b|\bnumber of\b",
    "place": r"\bwhere\b",
    "person": r"\bwho\b",
    "book": r"\bbook|books|read|suggestion\b",
    "event": r"\bevent|events|participat|attended|community\b",
    "activity": r"\bactivit|destress|hikes?|family|partake|does\b",
    "item": r"\bpaint|art|pottery|symbols?|items?|instruments?|pets?|names?|changes?|types?|ways?\b",
    "status": r"\bidentity|relationship status|career path\b",
}
ANSWER_SLOT_ORDER = ["count", "place", "person", "book", "event", "activity", "item", "status"]
PROFILE_SLOT_ORDER = ["status", "count", "place", "person", "book", "event", "activity", "item"]
# Expressions of time that a note's text may hold.
TEMPORAL_MARKERS = [
    "yesterday", "today", "tomorrow", "last week", "next week", "last month", "next month", "last year", "next year",
    "last monday", "last tuesday", "last wednesday", "last thursday", "last friday", "last saturday", "last sunday",
]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _ascii_borders(pattern: str) -> str:
    """One of the patterns above, with borders that know only ASCII words, as SQL's patterns have it; by Java's rule, letters of any script belong to words.

    Each of their borders stands before a word or after one. With (?d), only a line feed ends a line.
    """
    return "(?d)" + re.sub(r"\\b(?=[a-z(])", r"(?<!\\w)", pattern).replace(r"\b", r"(?!\w)")


def _found(c: Column, pattern: str, ascii_borders: bool) -> Column:
    return c.rlike(_ascii_borders(pattern) if ascii_borders else pattern)


def first_match(c: Column, rules: list[tuple[str, str]], default: str, ascii_borders: bool = False) -> Column:
    """The label of the first pattern that is found."""
    return reduce(lambda rest, rule: F.when(_found(c, rule[0], ascii_borders), rule[1]).otherwise(rest), reversed(rules), F.lit(default))


def _stem(t: Column) -> Column:
    """A lower-case token with one of four endings cut: ing, ies to y, ed, s."""
    n = F.length(t)
    return (
        F.when((n > 5) & t.endswith("ing"), F.substring(t, F.lit(1), n - 3))
        .when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("ed"), F.substring(t, F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def canonical_token(token: Column) -> Column:
    return _stem(F.lower(token))


def ascii_tokens(c: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Lower-case runs of ASCII letters and digits of some length, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def ascii_set(c: Column, least: int, stop: list[str]) -> Column:
    """The distinct ascii_tokens, in the order first seen."""
    return F.array_except(ascii_tokens(c, least), F.array(*map(F.lit, stop)))


def retrieval_tokens(c: Column) -> Column:
    """The set of stemmed retrieval tokens; the stop list sees the raw token. Only distinct tokens are stemmed."""
    return F.array_distinct(F.transform(ascii_set(c, 3, RETRIEVAL_STOP), _stem))


def overlap_tokens(c: Column) -> Column:
    return ascii_set(c, 3, OVERLAP_STOP)


def memory_tokens(c: Column) -> Column:
    """The set of words of letters, digits, underscores and inner hyphens of three or more characters, in any script, without stop words.

    A word that begins and ends at word borders is a run of these characters less the hyphens at its ends.
    """
    runs = F.regexp_extract_all(_text(c), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    found = F.transform(runs, lambda t: F.regexp_replace(F.lower(t), "^-+|-+$", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(MEMORY_STOP)))


def metric_tokens(c: Column) -> Column:
    """Lower-case words between blanks, with . , ! ? as blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(_text(c)), r"[.,!?]", " "), r"\s+"), lambda t: t != "")


def n_common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return n_common(a, b) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def note_fields(note: Column) -> Column:
    """The fields of a note block as a map; a later field of the same name wins."""
    names = "|".join(NOTE_FIELDS)
    pattern = F.lit(rf"(?s)(?:^|\n)({names}):\s*(.*?)(?=\n(?:{names}):|\z)")
    keys, values = F.regexp_extract_all(_text(note), pattern, F.lit(1)), F.regexp_extract_all(_text(note), pattern, F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")).alias("v"))
    last = lambda name: F.element_at(F.filter(pairs, lambda p: p["k"] == name), -1)["v"]
    return F.map_from_arrays(F.array(*map(F.lit, NOTE_FIELDS)), F.array(*[F.when(F.array_contains(keys, name), last(name)) for name in NOTE_FIELDS]))


def note_text(dia_id: Column, session_date: Column, speaker: Column, content: Column, caption: Column | None = None, query: Column | None = None) -> Column:
    """The block form of a turn; image lines only where present."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    optional = [F.when(c.isNotNull() & (c != ""), line(name, c)) for name, c in (("image_caption", caption), ("image_query", query)) if c is not None]
    return F.concat_ws("\n", line("dia_id", _text(dia_id)), line("session_date", _text(session_date)), line("speaker", _text(speaker)), line("content", _text(content)), *optional)


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), r"\s+", " "))


def rewrite_text(speaker: Column, session_date: Column, content: Column, caption: Column, query: Column) -> Column:
    """One line of evidence from a note's fields."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    fact = F.when(has(speaker), F.concat(speaker, F.lit(" evidence fact: "), _text(content))).otherwise(F.concat(F.lit("Evidence fact: "), _text(content)))
    return squeeze(
        F.concat_ws(
            " ", fact, F.when(has(session_date), F.concat(F.lit("time: "), session_date, F.lit("."))),
            F.when(has(caption), F.concat(F.lit("visual evidence: "), caption, F.lit("."))), F.when(has(query), F.concat(F.lit("visual query: "), query, F.lit("."))),
        )
    )


def index_text(rewrite: Column, dia_id: Column, session_date: Column, speaker: Column, keywords: Column, tags: Column, status: Column, caption: Column, query: Column) -> Column:
    """The document that retrieval indexes for a note."""
    metadata = F.trim(F.concat_ws(" ", _text(dia_id), _text(session_date), _text(speaker), F.array_join(keywords, " "), F.array_join(tags, " ")))
    visual = F.trim(F.concat_ws(" ", _text(caption), _text(query)))
    return F.concat_ws(" ", F.concat(F.lit("rewrite_content: "), rewrite), F.concat(F.lit("metadata: "), metadata), F.concat(F.lit("status: "), status), F.when(visual != "", F.concat(F.lit("visual cue: "), visual)))


def dia_session(dia_id: Column) -> Column:
    return F.regexp_extract(F.trim(_text(dia_id)), r"^D(\d+):(\d+)$", 1).try_cast("int")


def dia_turn(dia_id: Column) -> Column:
    return F.regexp_extract(F.trim(_text(dia_id)), r"^D(\d+):(\d+)$", 2).try_cast("int")


def dia_ids(c: Column) -> Column:
    """All turn ids in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"D\d+:\d+"), F.lit(0)))


def normalize_domain(path: Column) -> Column:
    """Up to three trimmed levels joined by slashes; > also divides."""
    parts = F.filter(F.transform(F.split(F.replace(_text(path), F.lit(">"), F.lit("/")), "/"), squeeze), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 3), " / ")).otherwise(F.lit(DEFAULT_DOMAIN))


def domain_prefixes(path: Column) -> Column:
    """Every level of a path: its prefixes."""
    parts = F.filter(F.transform(F.split(_text(path), "/"), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("General")))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " / "))


def domain_overlap(paths: Column, routes: Column) -> Column:
    """Whether a path equals, contains or lies in a route; no routes mean yes, no paths mean General."""
    own = F.when(F.coalesce(F.size(paths), F.lit(0)) > 0, paths).otherwise(F.array(F.lit("General")))
    touches = F.exists(own, lambda p: F.exists(routes, lambda r: (p == r) | r.startswith(F.concat(p, F.lit(" / "))) | p.startswith(F.concat(r, F.lit(" / ")))))
    return F.when(F.coalesce(F.size(routes), F.lit(0)) <= 0, F.lit(True)).otherwise(touches)


def slot_terms(query: Column) -> Column:
    """Names of the answer slots that a question asks for."""
    q = F.lower(_text(query))
    return F.array_compact(F.array(*[F.when(q.rlike(p), slot) for slot, p in SLOT_PATTERNS.items()]))


def query_expansion(query: Column, ascii_borders: bool = False) -> Column:
    """The question with evidence cues for multi-evidence retrieval."""
    q = F.lower(_text(query))
    none = F.array().cast("array<string>")
    cues = F.array_distinct(F.concat(*[F.when(_found(q, p, ascii_borders), F.array(*map(F.lit, terms))).otherwise(none) for p, terms in EXPANSIONS]))
    return F.when(F.size(cues) > 0, F.concat(_text(query), F.lit(" ; evidence cues: "), F.array_join(cues, " "))).otherwise(_text(query))


def retrieval_query(question: Column, keywords: Column) -> Column:
    """Question and keywords joined, unless they are the same or there are none."""
    k = F.trim(_text(keywords))
    return F.when((k == "") | (F.lower(k) == F.lower(F.trim(question))), question).otherwise(F.concat(question, F.lit(" ; "), k))


def answer_type(question: Column, ascii_borders: bool = False) -> Column:
    return first_match(F.lower(F.trim(_text(question))), ANSWER_TYPES, "factual_span", ascii_borders)


def slot_type(question: Column, order: list[str] = ANSWER_SLOT_ORDER, ascii_borders: bool = False) -> Column:
    return first_match(F.lower(_text(question)), [(SLOT_TYPE_PATTERNS[k], k) for k in order], "fact", ascii_borders)


def temporal_markers(c: Column) -> Column:
    low = F.lower(_text(c))
    return F.filter(F.array(*map(F.lit, TEMPORAL_MARKERS)), lambda m: low.contains(m))


#: A word of ASCII letters between word borders of any script.
KEYWORD = r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}(?![\p{L}\p{N}_])"


def heuristic_keywords(c: Column, most: int = 5) -> Column:
    """ASCII words of three or more letters, first seen, capitalised ones first. For texts of a turn's size; operators.keywords takes texts of any."""
    words = F.array_distinct(F.regexp_extract_all(_text(c), F.lit(KEYWORD), F.lit(0)))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(KEYWORD_STOP))
    first = F.filter(kept, lambda w, i: F.array_position(F.transform(kept, F.lower), F.lower(w)) == i + 1)
    upper = F.filter(first, lambda w: w.rlike("^[A-Z]"))
    lower = F.filter(first, lambda w: ~w.rlike("^[A-Z]"))
    return F.slice(F.transform(F.concat(upper, lower), F.lower), 1, most)


def heuristic_context(c: Column) -> Column:
    """The first sentence, else the first 200 characters."""
    sentence = F.regexp_extract(_text(c), r"^(.+?[.!?])\s", 1)
    return F.trim(F.when(sentence != "", sentence).otherwise(F.substring(_text(c), 1, 200)))


def strip_fences(c: Column) -> Column:
    """Model output without Markdown fences."""
    opened = F.regexp_replace(F.trim(_text(c)), r"(?m)^```(?:json)?\s*\n?", "")
    return F.regexp_replace(F.regexp_replace(opened, r"(?m)\n?\s*```$", ""), r"^\s+|\s+$", "")


def section(c: Column, marker: str, following: list[str]) -> Column:
    """The text after a header line's colon, up to the next of the named headers."""
    stop = "|".join(following)
    tail = rf"(?=^\s*(?:{stop})\s*:|\z)" if following else r"\z"
    return F.regexp_replace(F.regexp_extract(_text(c), rf"(?ims)^[ \t]*{marker}[ \t]*:[ \t]*(.*?){tail}", 1), r"^\s+|\s+$", "")


def list_items(c: Column) -> Column:
    """Items of a section: lines without bullets or numbers, cut at commas, without quotes."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), "^\"+|\"+$", ""), "^'+|'+$", ""))
    lines = F.transform(F.split(_text(c), r"\r?\n"), lambda x: bare(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*•]\s*", ""), r"^\d+[.)]\s*", "")))
    return F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, ","), bare))), lambda x: x != "")


def clamp_confidence(c: Column, default: float) -> Column:
    value = c.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
