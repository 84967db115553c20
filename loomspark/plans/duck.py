"""Pieces of DuckDB SQL that the twins of several queries share."""

from __future__ import annotations

from loomspark.functions import text as T
from loomspark.operators import bundle


def words(stop: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in stop) + ")"


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 5 AND suffix({t}, 'ing') THEN left({t}, length({t}) - 3) "
        f"WHEN length({t}) > 4 AND suffix({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 4 AND suffix({t}, 'ed') THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 3 AND suffix({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def ascii_words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def retrieval(x: str) -> str:
    return f"list_distinct([{stem('t')} FOR t IN {ascii_words(x)} IF length(t) >= 3 AND t NOT IN {words(T.RETRIEVAL_STOP)}])"


def overlap(x: str) -> str:
    return f"list_distinct([t FOR t IN {ascii_words(x)} IF length(t) >= 3 AND t NOT IN {words(T.OVERLAP_STOP)}])"


def memory(x: str) -> str:
    runs = f"[regexp_replace(lower(r), '^-+|-+$', '', 'g') FOR r IN regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_-]+')]"
    return f"list_distinct([t FOR t IN {runs} IF length(t) >= 3 AND t NOT IN {words(T.MEMORY_STOP)}])"


def metric(x: str) -> str:
    return f"[t FOR t IN string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[.,!?]', ' ', 'g'), '\\s+') IF t <> '']"


def common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    return f"({common(a, b)} / greatest(1, len(list_distinct(list_concat({a}, {b})))))"


def first_match(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{label}'" for p, label in rules) + f" ELSE '{default}' END"


def slots(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), '{p}') THEN '{s}' END" for s, p in T.SLOT_PATTERNS.items()) + "], lambda s: s IS NOT NULL)"


def lexical(q: str, m: str, v: str) -> str:
    """Of column names of query, main text and visual text."""
    a, b, c = retrieval(q), retrieval(m), retrieval(v)
    phrases = f"len([p FOR p IN string_split_regex(lower({q}), '[,;?]+') IF length(trim(p)) >= 8 AND contains(lower({m}), trim(p))])"
    return (
        f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE 3.0 * {common(a, b)} + 0.75 * {common(a, c)} + ({common(a, b)} + 0.5 * {common(a, c)}) / greatest(1, len({a})) + 0.25 * {phrases} END"
    )


ACTIONS = ("research", "apply", "paint", "read", "camp", "support", "birthday", "identity", "beach", "conference", "meeting")


def entity(q: str, speaker: str, exact: str) -> str:
    acts = " + ".join(f"CASE WHEN contains(lower({q}), '{a}') AND contains(lower({exact}), '{a}') THEN 1.5 ELSE 0.0 END" for a in ACTIONS)
    names = f"len([n FOR n IN list_distinct(regexp_extract_all({q}, '[\\p{{L}}\\p{{N}}_]+(?:''[a-z]+)?')) IF regexp_matches(n, '^[A-Z][a-z]+(?:''[a-z]+)?$') AND (lower(n) = lower({speaker}) OR contains(lower({exact}), lower(n)))])"
    inside = f"len([t FOR t IN {retrieval(q)} IF contains(lower({exact}), t)])"
    return f"CASE WHEN len({retrieval(q)}) = 0 THEN 0.0 ELSE 2.0 * {common(retrieval(q), retrieval(exact))} + 0.25 * {inside} + {names} + {acts} END"


def slot_signal(q: str, rewrite: str) -> str:
    hits = f"len([s FOR s IN {slots(q)} IF contains(lower({rewrite}), s) OR len(list_intersect(string_split(s, ' '), {retrieval(rewrite)})) > 0])"
    return (
        f"CAST(least(1.0, 0.18 * least(5, {common(retrieval(q), retrieval(rewrite))}) + 0.28 * least(2, {hits}) + CASE WHEN contains({rewrite}, ':') AND {hits} > 0 THEN 0.10 ELSE 0.0 END) AS DOUBLE)"
    )


def stemmed(word: str) -> str:
    """The stem of a lower-case word, for lists of constants."""
    n = len(word)
    if n > 5 and word.endswith("ing"):
        return word[:-3]
    if n > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if n > 4 and word.endswith("ed"):
        return word[:-2]
    return word[:-1] if n > 3 and word.endswith("s") else word


def slot_tokens(query: str, tokens: str) -> str:
    """What a note's tokens add to a question's."""
    return f"[t FOR t IN {tokens} IF NOT list_contains({retrieval(query)}, t) AND t NOT IN {words(bundle.GENERIC)}]"


def slot_kind(query: str) -> str:
    return first_match(f"lower(coalesce({query}, ''))", [(T.SLOT_TYPE_PATTERNS[k], k) for k in T.PROFILE_SLOT_ORDER], "fact")


def entities(plain: str) -> str:
    """Stems of capitalised words, of a text whose letters beyond ASCII are underscores, so that word borders are the same."""
    return f"list_distinct([{stem('t')} FOR t IN [lower(w) FOR w IN regexp_extract_all({plain}, '\\b[A-Z][A-Za-z0-9'']+\\b')] IF t NOT IN ('caroline', 'melanie')])"


def quoted(text: str) -> str:
    parts = f"""flatten([regexp_extract_all(s, '[A-Za-z0-9]+') FOR s IN regexp_extract_all({text}, '[''"]([^''"]{{2,80}})[''"]', 1)])"""
    return f"[{stem('t')} FOR t IN [lower(w) FOR w IN {parts}] IF length(t) >= 3]"


def slot_worth() -> str:
    """The slot score of rows with query, low, tokens, st, kind, ents and quoted."""
    cues = "CASE kind " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"{{'c': '{c}', 's': '{stemmed(c)}'}}" for c in v) + "]" for k, v in bundle.CUES.items() if v) + " ELSE [] END"
    hits = f"len([x FOR x IN {cues} IF contains(low, x.c) OR list_contains(tokens, x.s)])"
    targets = f"list_distinct([t FOR t IN {ascii_words('query')} IF length(t) >= 3 AND t NOT IN {words(bundle.QUESTION_TERMS)}])"
    numbers = f"[t FOR t IN tokens IF regexp_full_match(t, '[0-9]+') OR t IN {words(bundle.NUMBER_WORDS)}]"
    typed = f"CASE WHEN kind IN ('book', 'event', 'item', 'person', 'place') THEN len(list_distinct(list_concat(st, list_concat(ents, quoted)))) WHEN kind = 'count' THEN len(list_distinct(list_concat(st, {numbers}))) ELSE len(st) END"
    return f"2.0 * {hits} + 1.5 * {common(targets, 'tokens')} + 0.4 * least(10, {typed}) + CASE WHEN {hits} > 0 AND len(ents) > 0 THEN 1.0 ELSE 0.0 END"


#: Documents and questions with their token sets, and the BM25 score of every pair that shares a token.
BM25 = f"""
d AS (SELECT doc_id AS note_id, {retrieval("text")} AS tokens FROM documents),
q AS (SELECT item_id AS query_id, text AS query, {retrieval("text")} AS tokens FROM benchmark),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM d),
held AS (SELECT note_id, len(tokens) AS dl, unnest(tokens) AS token FROM d),
asked AS (SELECT query_id, unnest(tokens) AS token FROM q),
df AS (SELECT token, count(*) AS df FROM held GROUP BY token),
bm25 AS (
  SELECT query_id, note_id, sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * 2.5 / (1.0 + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-6)))) AS score
  FROM asked JOIN held USING (token) JOIN df USING (token), stats GROUP BY query_id, note_id)"""


def top(source: str, k: int) -> str:
    """The k best of each query of a relation (query_id, note_id, score)."""
    return f"SELECT * FROM (SELECT query_id, note_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, note_id DESC) AS INT) AS rank FROM {source}) WHERE rank <= {k}"


#: What documents have as notes beyond their text, by a rule on doc_id: status, successes, failures and citations.
LIFECYCLE = "CASE doc_id % 10 WHEN 7 THEN 'stale' WHEN 8 THEN 'candidate' WHEN 9 THEN 'deprecated' ELSE 'active' END AS status, doc_id % 5 AS success, doc_id % 3 AS failed, doc_id % 7 AS citations"


def expansion(q: str) -> str:
    """A question with its evidence cues."""
    quoted = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    terms = "flatten([" + ", ".join(f"CASE WHEN regexp_matches(lower({q}), '{p}') THEN {quoted(t)} ELSE [] END" for p, t in T.EXPANSIONS) + "])"
    once = f"[x FOR x, i IN {terms} IF list_position({terms}, x) = i]"
    return f"CASE WHEN len({terms}) > 0 THEN {q} || ' ; evidence cues: ' || array_to_string({once}, ' ') ELSE {q} END"


def rankers(category: int) -> str:
    """Notes n, questions q, and the relations dense, bm25, lexical and entity (query_id, note_id, score) over the notes that each question may see."""
    asked = expansion("coalesce(text, '')") if category == 1 else "text"
    place = "CAST('0x' || left(md5({0}), 8) AS BIGINT) % 64"
    acts = " + ".join(f"CASE WHEN contains(lower(lq), '{a}') AND contains(exact, '{a}') THEN 1.5 ELSE 0.0 END" for a in ACTIONS)
    return f"""
n AS (SELECT doc_id AS note_id, coalesce(text, '') AS main, lower(coalesce(text, '')) AS low, coalesce(source, '') AS source, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS exact, lang AS session,
  source || ' / ' || lang AS path, {LIFECYCLE}, {retrieval("text")} AS tokens, {retrieval("source")} AS seen FROM documents),
q0 AS (SELECT item_id AS query_id, text AS query, {asked} AS lq, regexp_matches(lower(text), 'previous|formerly|old|history|historical|archived') AS past FROM benchmark),
q AS (SELECT *, {retrieval("query")} AS qt, {retrieval("lq")} AS lt,
  list_distinct([x FOR x IN regexp_extract_all(lq, '[\\p{{L}}\\p{{N}}_]+(?:''[a-z]+)?') IF regexp_matches(x, '^[A-Z][a-z]+(?:''[a-z]+)?$')]) AS names,
  [trim(p) FOR p IN string_split_regex(lower(lq), '[,;?]+') IF length(trim(p)) >= 8] AS phrases FROM q0),
v AS (SELECT p.past, n.* FROM n, (VALUES (FALSE), (TRUE)) p(past) WHERE status IN ('active', 'candidate', 'stale') OR (p.past AND status IN ('deprecated', 'archived'))),
stats AS (SELECT past, count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM v GROUP BY past),
held AS (SELECT past, note_id, len(tokens) AS dl, unnest(tokens) AS token FROM v),
df AS (SELECT past, token, count(*) AS df FROM held GROUP BY ALL),
asked AS (SELECT query_id, past, unnest(lt) AS token FROM q),
bm25 AS (SELECT query_id, note_id, sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * 2.5 / (1.0 + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-6)))) AS score
  FROM asked JOIN held USING (past, token) JOIN df USING (past, token) JOIN stats USING (past) GROUP BY query_id, note_id),
places AS (SELECT past, note_id, {place.format("token")} AS place, CAST(count(*) AS DOUBLE) AS x FROM held GROUP BY ALL),
dv AS (SELECT past, note_id, place, x / sqrt(sum(x * x) OVER (PARTITION BY past, note_id)) AS x FROM places),
qplaces AS (SELECT query_id, past, {place.format("t")} AS place, CAST(count(*) AS DOUBLE) AS y FROM (SELECT query_id, past, unnest(qt) AS t FROM q) GROUP BY ALL),
qv AS (SELECT query_id, past, place, y / sqrt(sum(y * y) OVER (PARTITION BY query_id)) AS y FROM qplaces),
dense AS (SELECT query_id, note_id, sum(x * y) AS score FROM dv JOIN qv USING (past, place) GROUP BY query_id, note_id),
pairs AS (SELECT query_id, note_id, {common("lt", "tokens")} AS over, {common("lt", "seen")} AS vis, {common("lt", "list_distinct(list_concat(tokens, seen))")} AS spoken, len(lt) AS nt,
  len([p FOR p IN phrases IF contains(low, p)]) AS whole, len([t FOR t IN lt IF contains(exact, t)]) AS inside, len([x FOR x IN names IF contains(exact, lower(x))]) AS named, {acts} AS acts
  FROM q JOIN v ON v.past = q.past WHERE len(lt) > 0),
lexical AS (SELECT query_id, note_id, 3.0 * over + 0.75 * vis + (over + 0.5 * vis) / greatest(1, nt) + 0.25 * whole AS score FROM pairs WHERE over + vis + whole > 0),
entity AS (SELECT query_id, note_id, 2.0 * spoken + 0.25 * inside + named + acts AS score FROM pairs WHERE spoken + inside + named + acts > 0)"""
