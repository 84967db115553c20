"""Cue profiles of notes: what concrete things, people and topics a note is about, for typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T

# Cues that say nothing, phrases that say nothing, cues that tie notes strongly, phrases that always count, and tokens of value.
GENERIC = [
    "a", "an", "and", "are", "ask", "asked", "asking", "been", "being", "chat", "conversation", "day", "dialogue", "did", "does", "doing", "event", "events",
    "experience", "experiences", "felt", "feel", "feeling", "friend", "friends", "got", "had", "has", "have", "image", "images", "item", "items", "just", "memory",
    "memories", "mentioned", "new", "people", "person", "photo", "picture", "really", "said", "says", "session", "shared", "shares", "something", "talk", "talked",
    "talking", "thing", "things", "time", "today", "told", "turn", "want", "wanted", "week", "went", "would", "dia", "speaker", "content", "general", "gonna", "pretty",
    "out", "but", "one", "need", "needs", "i'm", "i've", "i'd", "it'll", "you", "your", "yours", "me", "my", "we", "our", "ours", "they", "them", "their", "there",
    "these", "those", "who", "what", "when", "where", "why", "how", "which", "the", "to", "of", "in", "on", "at", "by", "from", "for", "with", "without", "as", "is",
    "was", "were", "be", "am", "it", "its", "it's", "that", "this", "than", "then", "after", "before", "any", "anything", "anyth", "hey", "hi", "hello", "good",
    "great", "see", "yeah", "yes", "no", "thanks", "thank", "mel", "kid", "kids", "activity", "activities", "art", "arts", "career", "education", "evidence",
    "expression", "goal", "health", "identity", "life", "media", "meeting", "meetings", "object", "objects", "partner", "personal", "plan", "plans", "relationship",
    "relationships", "self", "travel", "visual", "wellbe", "wellbeing", "cool", "wow", "awesome", "inspir", "inspiring", "hear", "happy", "thankful", "such", "all",
    "story", "love", "lovely", "support", "about", "agree", "alway", "always", "care", "challenge", "each", "easy", "fun", "help", "important", "it'", "journey",
    "like", "long", "look", "make", "since", "super", "tak", "take", "taking", "that'", "think", "totally", "understand", "way", "work", "yourself", "ourselve",
    "ourselves", "you're", "here", "here'", "lot", "mean", "amaz", "amazing", "kind", "happen", "get", "job",
]
GENERIC_PHRASES = [
    "conversation memory", "image query", "memory content", "memory context", "personal experience", "talk start", "session date", "dia speaker", "speaker content", "session speaker",
]
STRONG = [
    "adoption", "agency", "agencies", "bach", "bareilles", "beach", "brave", "camping", "caroline", "certification", "children", "counseling", "dr seuss", "four seasons", "grandma", "lgbtq",
    "luna", "melanie", "mozart", "necklace", "oliver", "pottery", "pride", "psychology", "sara bareilles", "seuss", "shoes", "support group", "sweden", "the four seasons", "transgender", "violin",
]
PROTECTED = [
    "adoption agency", "adoption agencies", "charity race", "classic book", "classic books", "classical music", "counseling certification", "connected lgbtq activists", "dr seuss", "four seasons",
    "lgbtq activist group", "lgbtq support", "lgbtq support group", "mental health", "single parent", "support group", "the four seasons",
]
VALUED = [
    "adoption", "agency", "bach", "bareilles", "beach", "brave", "camp", "camping", "career", "certification", "child", "children", "counsel", "counseling", "grandma", "health", "lgbtq", "mental",
    "mozart", "necklace", "painting", "parent", "pottery", "psychology", "race", "seuss", "shoe", "shoes", "single", "sweden", "transgender", "violin",
]
COMMON = ["caroline", "melanie"]
QUOTED = r"['\"]([^'\"]{2,80})['\"]"
CAPITALISED = r"(?<![\p{L}\p{N}_])[A-Z][A-Za-z0-9']+(?:\s+(?:of|the|and|[A-Z][A-Za-z0-9']+)){0,4}"
# a word ends at a border of letters, digits and underscores, so a closing apostrophe stays outside unless a letter follows
WORD = r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z0-9']+(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def cue(c: Column) -> Column:
    """Lower case, anything but letters, digits, apostrophes and hyphens a blank, without a closing 's."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9'\s-]", " "), r"\s+", " ")
    trimmed = F.regexp_replace(bare, r"^[ '-]+|[ '-]+$", "")
    return F.regexp_replace(trimmed, r"'s$", "")


def useful(c: Column) -> Column:
    """Whether a cue says anything: a protected phrase always; else three characters or more, without digits, none of its words generic."""
    words = F.split(c, " ")
    plain = ~c.rlike(r"[0-9]") & (F.length(c) >= 3) & ~c.isin(GENERIC_PHRASES) & ~F.exists(words, lambda w: w.isin(GENERIC))
    return c.isin(PROTECTED) | plain


def _kept(cues: Column) -> Column:
    return F.filter(F.transform(cues, cue), useful)


def grams(tokens: Column, n: int) -> Column:
    """Runs of n useful tokens, as cues."""
    # an index past the end gives null, which concat_ws would skip: only whole runs are made
    runs = F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - n + 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.filter(runs, useful)


def tokens(c: Column) -> Column:
    """Useful stemmed words of a text, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(F.transform(words, T.canonical_token), useful)


def phrases(c: Column, segments: bool) -> Column:
    """Quoted, capitalised and (for lists) separated phrases of a text, as cues."""
    text = F.coalesce(c, F.lit(""))
    found = [F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))]
    if segments:
        found.append(F.filter(F.transform(F.split(text, r"[;,/|()\[\]\n]+"), lambda s: F.trim(s)), lambda s: F.length(s).between(2, 80)))
    return _kept(F.concat(*found))


def _cues(found: Column, words: Column) -> Column:
    return F.array_distinct(F.concat(found, words, grams(words, 2), grams(words, 3)))


def profiles(notes: DataFrame) -> DataFrame:
    """notes (speaker, content, image_caption, image_query, keywords, tags) with cues, strong and visual: sets of cues.

    Each text is cut into tokens once, in a projection of its own.
    """
    visual = F.concat_ws(" ", F.coalesce("image_caption", F.lit("")), F.coalesce("image_query", F.lit("")))
    listed = lambda name: F.array_join(F.coalesce(name, F.array().cast("array<string>")), " ; ")
    parts = {"content": F.col("content"), "visual": visual, "keywords": listed("keywords"), "tags": listed("tags")}
    split = notes.withColumns({f"_{n}_t": tokens(c) for n, c in parts.items()} | {f"_{n}_p": phrases(c, n != "content") for n, c in parts.items()})
    cues = split.withColumns({f"_{n}": _cues(F.col(f"_{n}_p"), F.col(f"_{n}_t")) for n in parts})
    worthy = F.filter(F.array_union("_keywords", "_tags"), lambda c: c.isin(PROTECTED) | c.isin(STRONG) | F.exists(F.split(c, " "), lambda w: w.isin(VALUED)))
    speaker = _kept(F.array(F.coalesce("speaker", F.lit(""))))
    whole = cues.withColumn("cues", F.array_distinct(F.concat("_content", worthy, speaker, "_visual"))).withColumn("visual", F.col("_visual"))
    long = [s for s in STRONG if " " in s]
    holds = lambda c: c.isin(STRONG) | F.exists(F.array(*map(F.lit, long)), lambda s: c.contains(s)) | ((F.size(F.split(c, " ")) >= 2) & F.exists(F.split(c, " "), lambda w: w.isin(VALUED)))
    strong = F.filter("cues", lambda c: ~c.isin(COMMON) & holds(c))
    return whole.withColumn("strong", strong).drop(*[f"_{n}{e}" for n in parts for e in ("", "_t", "_p")])
