"""Notes: text rules, lifecycle, the write path and the graph, over conversations and literal fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import dates
from loomspark.functions import text as T
from loomspark.operators import enrich, graph, keywords, lifecycle
from loomspark.plans import duck
from loomspark.plans.registry import Dealt, Fixture, literal, query, table
from loomspark.sources import dialogue


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as notes: a conversation is a sample and a session, a role a speaker."""
    rows = table(spark, sf_dir, "conversations").withColumn("dia_id", F.concat(F.lit("D"), F.col("conv_id"), F.lit(":"), F.col("turn")))
    return rows.select(
        F.col("conv_id").alias("sample_id"), F.col("dia_id").alias("note_id"), F.col("turn").alias("ord"), F.col("conv_id").alias("session"), "turn", F.col("role").alias("speaker"),
        F.coalesce("text", F.lit("")).alias("content"), "dia_id",
    )


_NOTES = "notes AS (SELECT conv_id AS sample_id, 'D' || conv_id || ':' || turn AS note_id, turn AS ord, conv_id AS session, turn, role AS speaker, coalesce(text, '') AS content FROM conversations)"


@query(f"SELECT word, {duck.stem('w')} AS stem FROM (SELECT DISTINCT word, lower(word) AS w FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS word FROM documents))")
def stemmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every distinct word of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.canonical_token(F.col("word")).alias("stem"))


@query(f"SELECT doc_id, array_to_string(list_sort({duck.retrieval('text')}), ' ') AS tokens FROM documents")
def retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.retrieval_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort({duck.overlap('text')}), ' ') AS overlap, array_to_string(list_sort({duck.memory('text')}), ' ') AS memory FROM conversations")
def overlap_and_memory_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.array_join(F.array_sort(c), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", show(T.overlap_tokens(F.col("text"))).alias("overlap"), show(T.memory_tokens(F.col("text"))).alias("memory"))


@query(f"SELECT conv_id, turn, array_to_string({duck.metric('text')}, '|') AS tokens FROM conversations")
def simple_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.metric_tokens(F.col("text")), "|").alias("tokens"))


@query(f"WITH {_NOTES} SELECT note_id, 'dia_id: ' || note_id || chr(10) || 'session_date: ' || chr(10) || 'speaker: ' || speaker || chr(10) || 'content: ' || content AS note FROM notes")
def note_text_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note_id", T.note_text(F.col("dia_id"), F.lit(""), F.col("speaker"), F.col("content")).alias("note"))


@query(f"WITH {_NOTES} SELECT note_id, note_id AS dia_id, speaker, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, CASE WHEN turn % 2 = 0 THEN 'a cat' END AS image_caption FROM notes")
def field_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note block written and parsed again."""
    block = T.note_text(F.col("dia_id"), F.lit("1:56 pm on 8 May, 2023"), F.col("speaker"), F.col("content"), F.when(F.col("turn") % 2 == 0, "a cat"), F.lit(None).cast("string"))
    parsed = notes(spark, sf_dir).select("note_id", T.note_fields(block).alias("f"))
    return parsed.select("note_id", *[F.col("f")[k].alias(k) for k in ("dia_id", "speaker", "content", "image_caption")])


@query(
    f"""WITH {_NOTES}, r AS (SELECT note_id, trim(regexp_replace(speaker || ' evidence fact: ' || content || ' time: 8 May, 2023.', '\\s+', ' ', 'g')) AS rewrite, speaker FROM notes)
SELECT note_id, rewrite, 'rewrite_content: ' || rewrite || ' metadata: ' || note_id || ' 8 May, 2023 ' || speaker || ' k status: active' AS index_text FROM r"""
)
def rewrite_and_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    rows = notes(spark, sf_dir).withColumn("rewrite", T.rewrite_text(F.col("speaker"), F.lit("8 May, 2023"), F.col("content"), none, none))
    text = T.index_text(F.col("rewrite"), F.col("dia_id"), F.lit("8 May, 2023"), F.col("speaker"), F.array(F.lit("k")), F.array().cast("array<string>"), F.lit("active"), none, none)
    return rows.select("note_id", "rewrite", text.alias("index_text"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
k AS (SELECT doc_id, lower(w) AS l, min(i) AS i, arg_min(CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2 ELSE 1 END, i) AS s FROM p
  WHERE regexp_matches(w, '^[a-zA-Z]{3,}$') AND lower(w) NOT IN """
    + duck.words(T.KEYWORD_STOP)
    + """ GROUP BY doc_id, lower(w)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS rn FROM k)
SELECT d.doc_id, coalesce(string_agg(r.l, ' ' ORDER BY rn) FILTER (rn <= 5), '') AS keywords FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""
)
def heuristic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keywords(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.array_join("keywords", " ").alias("keywords"))


QUESTIONS = Dealt(
    "question string",
    [(q,) for q in (
        "When did Ann go?", "How many pets does Ann have?", "What personality traits would she show?", "What would Ann likely be doing?", "Would Ann move?", "What books has Ann read?",
        "Did Ann paint?", "Who supports Ann?", "Where does Ann camp?", "What is it", "What activities does the family partake in to destress?", "Which musical artists did Ann see in concert?",
        "What is her identity and relationship status?", "Which events has she attended in the community?", "What items did she buy?", "What did she start at the beach?", "", "WHERE was the art?",
    )],
    ("question",),
)


# letters beyond ASCII as underscores: word borders are then the same for both engines
_ASKED = f"(SELECT *, regexp_replace(question, '[À-ÖØ-öø-ɏ]', '_', 'g') AS plain FROM {QUESTIONS.sql})"


@query(f"SELECT conv_id, turn, {duck.first_match('lower(trim(plain))', T.ANSWER_TYPES, 'factual_span')} AS answer_type FROM {_ASKED}")
def answer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUESTIONS.deal(spark, sf_dir).select("conv_id", "turn", T.answer_type(F.col("question")).alias("answer_type"))


_SLOT = lambda order: duck.first_match("lower(question)", [(T.SLOT_TYPE_PATTERNS[k], k) for k in order], "fact")


@query(f"SELECT conv_id, turn, {_SLOT(T.ANSWER_SLOT_ORDER)} AS answer_slot, {_SLOT(T.PROFILE_SLOT_ORDER)} AS profile_slot, array_to_string({duck.slots('question')}, ',') AS slots FROM (SELECT conv_id, turn, plain AS question FROM {_ASKED})")
def slot_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return QUESTIONS.deal(spark, sf_dir).select("conv_id", "turn", T.slot_type(q).alias("answer_slot"), T.slot_type(q, T.PROFILE_SLOT_ORDER).alias("profile_slot"), F.array_join(T.slot_terms(q), ",").alias("slots"))


_TERMS = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(plain), '{p}') THEN {literal(terms)} ELSE [] END" for p, terms in T.EXPANSIONS) + "]"


@query(
    f"""WITH f AS (SELECT conv_id, turn, question, flatten({_TERMS}) AS terms FROM {_ASKED}),
u AS (SELECT conv_id, turn, question, [terms[i] FOR i IN range(1, len(terms) + 1) IF list_position(terms, terms[i]) = i] AS terms FROM f)
SELECT conv_id, turn, CASE WHEN len(terms) > 0 THEN question || ' ; evidence cues: ' || array_to_string(terms, ' ') ELSE question END AS expanded FROM u"""
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUESTIONS.deal(spark, sf_dir).select("conv_id", "turn", T.query_expansion(F.col("question")).alias("expanded"))


FACTS = Dealt(
    "id int, stamp string, fact string, question string, response string",
    [
        (1, "1:56 pm on 8 May, 2023", "I went yesterday.", "When?", "yesterday"), (2, "1:56 pm on 8 May, 2023", "See you tomorrow, not today", "When?", "unknown"),
        (3, "2 pm on 1 January, 2024", "It was last month and last week", "When?", "last week"), (4, "on 31 December, 2022", "We meet next month", "When?", "in summer"),
        (5, "on 5 June, 2021", "Last tues. we met", "When?", "last tuesday"), (6, "on 5 June, 2021", "last year we moved, since 2016", "When?", "not mentioned"),
        (7, "on 5 June, 2021", "married for five years", "How long?", "n/a"), (8, "on 5 June, 2021", "born on 3 march 1999", "What date?", "none"),
        (9, "on 5 June, 2021", "in 2019 we sang", "When?", ""), (10, "no date", "yesterday", "When?", "yesterday"), (11, "on 9 July, 2023", "the weekend before was fun this month", "When?", "9 July 2023"),
        (12, "on 9 July, 2023", "nothing here", "When?", "unknown"),
    ],
    ("fact", "question"),
)


@query(f"SELECT conv_id, turn, strftime(try_strptime(regexp_extract(stamp, 'on\\s+(\\d{{1,2}}\\s+[A-Za-z]+,\\s+\\d{{4}})', 1), '%d %B, %Y'), '%Y-%m-%d') AS day FROM {FACTS.sql}")
def session_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FACTS.deal(spark, sf_dir).select("conv_id", "turn", dates.session_date(F.col("stamp")).cast("string").alias("day"))


_DAY = "strftime({0}, '%-d %B %Y')"
_WD = "CASE left(regexp_extract(t, '{0}', 1), 3) WHEN 'mon' THEN 'Monday' WHEN 'tue' THEN 'Tuesday' WHEN 'wed' THEN 'Wednesday' WHEN 'thu' THEN 'Thursday' WHEN 'fri' THEN 'Friday' WHEN 'sat' THEN 'Saturday' WHEN 'sun' THEN 'Sunday' END".format(dates.LAST_WEEKDAY)
_EXPLICIT = rf"\b(\d{{1,2}}\s+(?:{dates.MONTHS})\s+\d{{4}})\b"
_RULES = [
    ("contains(t, 'yesterday')", _DAY.format("d - INTERVAL 1 DAY")), ("contains(t, 'today')", _DAY.format("d")), ("contains(t, 'tomorrow')", _DAY.format("d + INTERVAL 1 DAY")),
    ("regexp_matches(t, 'last weekend|the weekend before|previous weekend')", "'The weekend before ' || " + _DAY.format("d")),
    (r"regexp_matches(t, '\blast week\b|the week before')", "'The week before ' || " + _DAY.format("d")), (f"regexp_matches(t, '{dates.LAST_WEEKDAY}')", f"'The ' || {_WD} || ' before ' || " + _DAY.format("d")),
    ("contains(t, 'last month')", "strftime(d - INTERVAL 1 MONTH, '%B %Y')"), ("contains(t, 'next month')", "strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%B %Y')"),
    ("contains(t, 'this month')", "strftime(d, '%B %Y')"), ("contains(t, 'last year')", "CAST(year(d) - 1 AS VARCHAR)"), (r"regexp_matches(t, '\bsince\s+\d{4}\b')", r"'Since ' || regexp_extract(t, '\bsince\s+(\d{4})\b', 1)"),
    (f"regexp_matches(t, '{dates.DURATION}')", f"regexp_extract(t, '{dates.DURATION}', 1) || ' years'"),
    (f"regexp_matches(t, '{_EXPLICIT}') AND contains(lower(question), 'what date')", "strftime(try_strptime(regexp_extract(t, '" + _EXPLICIT + "', 1), '%d %B %Y'), '%-d %B %Y')"),
]


@query(
    f"""WITH f AS (SELECT conv_id, turn, question, lower(fact) AS t, try_strptime(regexp_extract(stamp, 'on\\s+(\\d{{1,2}}\\s+[A-Za-z]+,\\s+\\d{{4}})', 1), '%d %B, %Y') AS d FROM {FACTS.sql}),
c AS (SELECT conv_id, turn, t, d, list_filter([{", ".join(f"CASE WHEN {w} THEN {v} END" for w, v in _RULES)}], lambda x: x IS NOT NULL) AS found FROM f)
SELECT conv_id, turn, array_to_string(CASE WHEN d IS NULL THEN [] WHEN len(found) > 0 THEN found WHEN regexp_matches(t, '\\b(?:in|during)\\s+(\\d{{4}})\\b') THEN [regexp_extract(t, '\\b(?:in|during)\\s+(\\d{{4}})\\b', 1)] ELSE [] END, ' | ') AS answers FROM c"""
)
def temporal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dates.temporal_candidates(dates.session_date(F.col("stamp")), F.col("fact"), F.col("question"))
    return FACTS.deal(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(found, lambda c: c["answer"]), " | ").alias("answers"))


RESOLVED = Fixture("id int, answer string", [(1, "7 May 2023"), (2, "8 May 2023"), (3, "The week before 1 January 2024"), (4, "January 2023"), (5, "The Tuesday before 5 June 2021"), (6, "2020"), (7, "five years"), (8, "3 March 1999"), (9, "2019"), (10, "yesterday"), (11, "July 2023"), (12, "unknown")])


@query(f"SELECT conv_id, turn, answer FROM {FACTS.sql} JOIN {RESOLVED.sql} USING (id)")
def temporal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final date answers against worked-out ones."""
    return FACTS.deal(spark, sf_dir).select("conv_id", "turn", dates.resolve_answer(F.col("response"), dates.session_date(F.col("stamp")), F.col("fact"), F.col("question")).alias("answer"))


@query(f"SELECT conv_id, turn, array_to_string([m FOR m IN {literal(T.TEMPORAL_MARKERS)} IF contains(lower(fact), m)], ',') AS markers FROM {FACTS.sql}")
def temporal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FACTS.deal(spark, sf_dir).select("conv_id", "turn", F.array_join(T.temporal_markers(F.col("fact")), ",").alias("markers"))


STATES = Dealt("status string, asked string", [(s, q) for s in ("active", "candidate", "stale", "deprecated", "archived", "odd") for q in ("What is her job?", "What was her previous job?")], ("asked",))
_PENALTY = "CASE status " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in lifecycle.PENALTY.items()) + " ELSE 0.0 END"


@query(f"SELECT conv_id, turn, status, CAST({_PENALTY} AS DOUBLE) AS penalty FROM {STATES.sql}")
def lifecycle_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATES.deal(spark, sf_dir).select("conv_id", "turn", "status", lifecycle.penalty(F.col("status")).alias("penalty"))


@query(f"SELECT conv_id, turn, status, status IN ('active', 'candidate', 'stale') AS indexable, status IN ('active', 'candidate', 'stale') OR (status IN ('deprecated', 'archived') AND regexp_matches(lower(asked), 'previous|formerly|old|history|historical|archived')) AS retrievable FROM {STATES.sql}")
def lifecycle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATES.deal(spark, sf_dir).select("conv_id", "turn", "status", lifecycle.is_indexable(F.col("status")).alias("indexable"), lifecycle.is_retrievable(F.col("status"), F.col("asked")).alias("retrievable"))


PATHS = Dealt(
    "paths array<string>, routes array<string>",
    [(["A / B"], ["A / B"]), (["A"], ["A / B"]), (["A / B"], ["A"]), (["AB"], ["A"]), (["X"], ["A", "X / Y"]), (None, ["General"]), ([], ["A"]), (["A"], None), (["A"], [])],
)
PATHS.names = ["paths", "routes"]
_OWN = "CASE WHEN coalesce(len(paths), 0) > 0 THEN paths ELSE ['General'] END"


@query(f"SELECT conv_id, turn, array_to_string(coalesce(paths, ['-']), ',') AS paths, array_to_string(coalesce(routes, ['-']), ',') AS routes, coalesce(len(routes), 0) = 0 OR len([1 FOR p IN {_OWN} IF len([1 FOR r IN routes IF p = r OR starts_with(r, p || ' / ') OR starts_with(p, r || ' / ')]) > 0]) > 0 AS overlap FROM {PATHS.sql}")
def domain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.array_join(F.coalesce(F.col(c), F.array(F.lit("-"))), ",")
    told = PATHS.deal(spark, sf_dir).withColumn("overlap", T.domain_overlap(F.col("paths"), F.col("routes"))).withColumns({c: show(c) for c in ("paths", "routes")})
    return told.select("conv_id", "turn", "paths", "routes", "overlap")


DOMAINS = Dealt("path string", [(p,) for p in ("A / B", " A>B > C / D", "", "a  b /  c", None, " / ", "Talk >")])


@query(f"SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN array_to_string(p[1:3], ' / ') ELSE 'General / Conversation / Episodic' END AS domain FROM (SELECT conv_id, turn, [trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN string_split(replace(coalesce(path, ''), '>', '/'), '/') IF trim(x) <> ''] AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN path || '/ ' || role ELSE path END AS path FROM {DOMAINS.sql}))")
def domain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("turn") % 2 == 1, F.concat("path", F.lit("/ "), "role")).otherwise(F.col("path"))
    return DOMAINS.deal(spark, sf_dir).select("conv_id", "turn", T.normalize_domain(path).alias("domain"))


DECISIONS = Dealt(
    "id int, new_text string, old_text string, overlap double",
    [
        (1, "maybe she moves", "she lives here", 0.5), (2, "she moved to Rome", "a cat", 0.01), (3, "she now lives in Rome", "she lives in Oslo", 0.4), (4, "she likes tea while reading", "she reads", 0.2),
        (5, "she has a red car", "she has a car", 0.5), (6, "she has a car", "a red one", 0.1), (7, "she has a car", None, None), (8, "currently a car", "a cat", 0.1),
    ],
    ("new_text", "old_text"),
)
_IN = lambda c, markers: "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in markers) + ")"
_BOTH = "concat_ws(' ', old_text, new_text)"
_COND = " + ".join(f"CASE WHEN contains(lower({_BOTH}), '{m}') THEN 1 ELSE 0 END" for m in lifecycle.CONDITIONAL)
_ACTION = f"""CASE WHEN {_IN("new_text", lifecycle.UNCERTAIN)} THEN 'mark_candidate_uncertain' WHEN coalesce(overlap, -1) < 0.08 THEN 'create_separate_memory'
WHEN {_IN("new_text", lifecycle.SUPERSEDING)} AND overlap >= 0.16 THEN 'overwrite_existing' WHEN {_COND} >= 2 THEN 'refine_conditions' WHEN overlap >= 0.16 THEN 'append_detail' ELSE 'create_separate_memory' END"""


@query(f"WITH d AS (SELECT *, {_ACTION} AS action FROM {DECISIONS.sql}) SELECT conv_id, turn, action, CASE action WHEN 'overwrite_existing' THEN 'same_entity' WHEN 'refine_conditions' THEN 'same_topic' WHEN 'append_detail' THEN 'elaborates' ELSE 'semantic_related' END AS relation, CAST(CASE action WHEN 'mark_candidate_uncertain' THEN 0.4 WHEN 'overwrite_existing' THEN 0.75 WHEN 'refine_conditions' THEN 0.7 WHEN 'append_detail' THEN 0.65 ELSE 0.6 END AS DOUBLE) AS confidence FROM d")
def heuristic_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = DECISIONS.deal(spark, sf_dir).select("conv_id", "turn", lifecycle.decide(F.col("new_text"), F.col("old_text"), F.col("overlap")).alias("d"))
    return made.select("conv_id", "turn", "d.action", "d.relation", "d.confidence")


@query(f"SELECT conv_id, turn, m AS mode, CASE m WHEN 'overwrite_existing' THEN new_text WHEN 'refine_conditions' THEN old_text || ' Also, under a different condition or context, ' || new_text ELSE CASE WHEN contains(old_text, new_text) THEN old_text ELSE old_text || ' ' || new_text END END AS content FROM {DECISIONS.sql}, (SELECT unnest({literal(list(lifecycle.MERGING))}) AS m) WHERE old_text IS NOT NULL")
def deterministic_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = DECISIONS.deal(spark, sf_dir).where("old_text IS NOT NULL").select("conv_id", "turn", "new_text", "old_text", F.explode(F.array(*map(F.lit, lifecycle.MERGING))).alias("mode"))
    return rows.select("conv_id", "turn", "mode", lifecycle.merged_content(F.col("mode"), F.col("old_text"), F.col("new_text")).alias("content"))


@query(
    """WITH n AS (SELECT 'D' || conv_id || ':' || turn AS note_id, coalesce(text, '') AS content, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
SELECT note_id, unnest([1, 2]) AS version, unnest([content, content || ' ' || next]) AS content, unnest(['Initial memory before write-time consolidation.', 'append']) AS reason FROM n WHERE next IS NOT NULL AND NOT contains(content, next)"""
)
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn extended by the next one: its versions."""
    rows = notes(spark, sf_dir).withColumn("next", F.lead("content").over(Window.partitionBy("sample_id").orderBy("turn"))).where("next IS NOT NULL AND NOT contains(content, next)")
    none = F.array().cast("array<struct<version:int,content:string,update_reason:string,source_memory_id:string,timestamp:string>>")
    merged = lifecycle.merged_content(F.lit("append_detail"), F.col("content"), F.col("next"))
    history = lifecycle.revision_rows(none, F.lit(1), F.col("content"), merged, F.lit("t0"), F.lit("t1"), F.lit("append"), F.lit("s"))
    return rows.select("note_id", F.explode(history).alias("h")).select("note_id", "h.version", "h.content", F.col("h.update_reason").alias("reason"))


@query(
    """WITH n AS (SELECT conv_id, turn, role, 'D' || conv_id || ':' || turn AS note_id, coalesce(text, '') AS content FROM conversations),
c AS (SELECT conv_id, turn, role, 'D' || conv_id || ':' || turn AS note_id, 'changed' AS content FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 99, 'new', 'D' || conv_id || ':99', 'new' FROM conversations WHERE turn = 0)
SELECT note_id, role AS speaker, content FROM n WHERE note_id NOT IN (SELECT note_id FROM c) UNION ALL SELECT note_id, role, content FROM c"""
)
def note_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge of changed and new notes into the table."""
    rows = notes(spark, sf_dir).select("sample_id", "turn", "note_id", "speaker", "content")
    first = rows.where("turn = 0")
    new = first.select("sample_id", "turn", F.concat(F.lit("D"), "sample_id", F.lit(":99")).alias("note_id"), F.lit("new").alias("speaker"), F.lit("new").alias("content"))
    changes = first.withColumn("content", F.lit("changed")).unionByName(new)
    return lifecycle.upsert(rows, changes, "note_id").select("note_id", "speaker", "content")


@query(
    f"""WITH t AS (SELECT conv_id, turn, {duck.memory("text")} AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS other, {duck.jaccard("a.w", "b.w")} AS j FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn < a.turn),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(j, 9) DESC, other) AS rn FROM p WHERE j > 0)
SELECT conv_id, turn, other AS best_turn, round(j, 6) AS overlap FROM r WHERE rn = 1"""
)
def jaccard_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each note, of the earlier notes of its sample the first of largest overlap, by whole texts."""
    rows = notes(spark, sf_dir).withColumn("tokens", T.memory_tokens(F.col("content")))
    best = graph.best_overlap(rows.select("sample_id", "note_id", "ord", "tokens"))
    order = lambda c: F.regexp_extract(c, r":(\d+)$", 1).cast("long")
    return best.select(F.col("sample_id").alias("conv_id"), order("note_id").alias("turn"), order("best_id").alias("best_turn"), F.round("overlap", 6).alias("overlap"))


@query(
    """WITH p AS (SELECT conv_id AS sample_id, 'D' || conv_id || ':' || turn AS a, lead('D' || conv_id || ':' || turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM conversations)
SELECT sample_id, a AS src_id, b AS target_id, 'same_character' AS relation, CAST(0.4 AS DOUBLE) AS strength FROM p WHERE b IS NOT NULL UNION ALL SELECT sample_id, b, a, 'same_character', 0.4 FROM p WHERE b IS NOT NULL"""
)
def edges_same_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.same_character(notes(spark, sf_dir))


@query(
    """WITH s AS (SELECT unnest([-1, 1, -2, 2]) AS d, unnest([1, 2, 3, 4]) AS place),
f AS (SELECT a.conv_id AS sample_id, 'D' || a.conv_id || ':' || a.turn AS src_id, 'D' || b.conv_id || ':' || b.turn AS target_id, place FROM conversations a, s JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + s.d)
SELECT sample_id, src_id, target_id, CAST(row_number() OVER (PARTITION BY sample_id, src_id ORDER BY place) AS INT) AS pos FROM f"""
)
def local_context_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.local_neighbours(notes(spark, sf_dir), 2)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with token sets; longer tokens are cues, the longest strong ones."""
    rows = notes(spark, sf_dir).withColumn("tokens", T.retrieval_tokens(F.col("content")))
    long = lambda n: F.filter("tokens", lambda t: F.length(t) >= n)
    return rows.select("sample_id", "note_id", "ord", "session", "turn", "speaker", "tokens", long(6).alias("cues"), long(9).alias("strong"), F.array().cast("array<string>").alias("visual"))


_TYPED = f"""WITH {_NOTES}, t AS (SELECT sample_id, note_id, ord, speaker, {duck.retrieval("content")} AS tokens FROM notes),
p AS (SELECT *, [x FOR x IN tokens IF length(x) >= 6] AS cues, [x FOR x IN tokens IF length(x) >= 9] AS strong FROM t),
j AS (SELECT a.sample_id, a.note_id AS a, b.note_id AS b, a.ord AS ao, b.ord AS bo, a.speaker = b.speaker AS same, {duck.common("a.tokens", "b.tokens")} AS over, {duck.jaccard("a.tokens", "b.tokens")} AS sim,
  {duck.common("a.strong", "b.strong")} AS strong, len([x FOR x IN list_intersect(a.cues, b.cues) IF x NOT IN ('caroline', 'melanie', lower(a.speaker), lower(b.speaker))]) AS shared
  FROM p a JOIN p b ON a.sample_id = b.sample_id AND a.ord < b.ord),
e AS (SELECT *, least(0.92, 0.60 + 0.08 * least(3, strong) + 0.04 * least(3, shared) + CASE WHEN same THEN 0.08 ELSE 0.0 END) AS strength FROM j
  WHERE ((same AND strong > 0) OR (same AND shared >= 2) OR (NOT same AND strong >= 2)) AND (over >= 1 OR sim >= 0.25 OR strong > 0)),
d AS (SELECT sample_id, a AS src_id, b AS target_id, ao, bo, strength FROM e UNION ALL SELECT sample_id, b, a, ao, bo, strength FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, src_id ORDER BY ao, bo) AS rn FROM d)
SELECT sample_id, src_id, target_id, 'same_storyline' AS relation, round(CAST(strength AS DOUBLE), 6) AS strength FROM r WHERE rn <= 8"""


@query(_TYPED)
def edges_typed_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = graph.cap_typed(graph.storyline_edges(graph.pair_features(_profiles(spark, sf_dir))))
    return capped.select("sample_id", "src_id", "target_id", "relation", F.round("strength", 6).alias("strength"))


_SIMILAR = f"""WITH RECURSIVE {_NOTES}, t AS (SELECT sample_id, note_id, ord, turn, {duck.retrieval("content")} AS tokens FROM notes),
j AS (SELECT a.sample_id, a.note_id AS a, b.note_id AS b, row_number() OVER (PARTITION BY a.sample_id ORDER BY a.ord, b.ord) AS k
  FROM t a JOIN t b ON a.sample_id = b.sample_id AND a.ord < b.ord AND b.turn - a.turn <= 4 WHERE {duck.common("a.tokens", "b.tokens")} >= 2 OR {duck.jaccard("a.tokens", "b.tokens")} >= 0.60),
f AS (SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, '' AS a, '' AS b, FALSE AS taken FROM j
  UNION ALL SELECT sample_id, k, CASE WHEN ok THEN list_concat(used, [a, b]) ELSE used END, a, b, ok
  FROM (SELECT j.*, f.used, len([x FOR x IN f.used IF x = j.a]) < 4 AND len([x FOR x IN f.used IF x = j.b]) < 4 AS ok FROM f JOIN j ON j.sample_id = f.sample_id AND j.k = f.k + 1))
SELECT sample_id, a AS src_id, b AS target_id, 'similar_event' AS relation, CAST(1.0 AS DOUBLE) AS strength FROM f WHERE taken
UNION ALL SELECT sample_id, b, a, 'similar_event', CAST(1.0 AS DOUBLE) FROM f WHERE taken"""


@query(_SIMILAR)
def edges_similar_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar notes of a sample, at most four at either end, in order; the twin is a fold by recursion."""
    return graph.similar_events(graph.pair_features(_profiles(spark, sf_dir)))


EDGES = Dealt("src string, target string, relation string, strength double", [("a", "b", "same_topic", 0.2), ("a", "b", "same_topic", 0.7), ("a", "b", "supports", 0.1), ("b", "a", "replaces", 0.9), ("b", "c", "odd", 0.5), ("c", "a", "co_used", 0.5), ("c", "c", "co_used", 0.9)])
_EDGES = f"SELECT conv_id % 10 AS sample_id, src AS src_id, target AS target_id, relation, strength + turn / 100.0 AS strength, 'said in ' || conv_id || ', ' || turn AS reason, conv_id * 1000 + turn AS n FROM {EDGES.sql}"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten samples' edges, some many times over, each with its reason and place."""
    dealt = EDGES.deal(spark, sf_dir)
    return dealt.select(
        (F.col("conv_id") % 10).alias("sample_id"), F.col("src").alias("src_id"), F.col("target").alias("target_id"), "relation", (F.col("strength") + F.col("turn") / 100.0).alias("strength"),
        F.concat(F.lit("said in "), "conv_id", F.lit(", "), "turn").alias("reason"), (F.col("conv_id") * 1000 + F.col("turn")).alias("n"),
    )


@query(f"SELECT sample_id, src_id, target_id, relation, round(CAST(max(strength) AS DOUBLE), 6) AS strength, arg_min(reason, n) AS reason FROM ({_EDGES}) WHERE relation IN {duck.words(lifecycle.RELATIONS)} AND src_id <> target_id GROUP BY ALL")
def edge_upsert_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge of each kind with the largest strength and the first reason."""
    return graph.upsert_edges(_edges(spark, sf_dir), "n").withColumn("strength", F.round("strength", 6))


@query(f"SELECT n, src_id, target_id, relation, CASE WHEN relation IN {duck.words(lifecycle.FORBIDDEN)} THEN 'none' WHEN relation IN {duck.words(lifecycle.RELATIONS)} THEN relation ELSE 'semantic_related' END AS kept FROM ({_EDGES})")
def edge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("n", "src_id", "target_id", "relation", lifecycle.edge_relation(F.col("relation")).alias("kept"))


@query(
    """WITH qa AS (SELECT conv_id AS sample_id, turn AS qa_id, unnest(CASE WHEN turn % 4 = 3 THEN ['none'] ELSE ['D9:' || (turn + 2), 'D' || conv_id || ':' || (turn * 3)] END) AS e FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id AS sample_id, 'D' || conv_id || ':' || turn AS dia_id FROM conversations WHERE turn % 3 = 0 AND text IS NOT NULL)
SELECT DISTINCT sample_id, qa_id FROM qa WHERE contains(e, ':') AND EXISTS (SELECT 1 FROM p WHERE p.sample_id = qa.sample_id AND suffix(dia_id, split_part(e, ':', -1)))"""
)
def image_suffix_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions whose evidence names turns; every third turn has a picture, captioned with its text."""
    rows = table(spark, sf_dir, "conversations")
    named = F.array(F.concat(F.lit("D9:"), (F.col("turn") + 2).cast("string")), F.concat(F.lit("D"), "conv_id", F.lit(":"), (F.col("turn") * 3).cast("string")))
    qa = rows.where("role = 'user'").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("qa_id"), F.when(F.col("turn") % 4 == 3, F.array(F.lit("none"))).otherwise(named).alias("evidence"))
    turns = rows.select(F.col("conv_id").alias("sample_id"), F.concat(F.lit("D"), "conv_id", F.lit(":"), "turn").alias("dia_id"), F.when(F.col("turn") % 3 == 0, F.col("text")).alias("image_caption"))
    return dialogue.image_evidence(qa, turns)


# what stands between the marks is a turn's role, conversation or number; rows 3 and 4 offer nothing, so the content's own words serve
RESPONSES = Dealt(
    "id int, response string",
    [(1, 'KEYWORDS: <role>, tea\nCONTEXT: A talk in <conv>.\nTAGS: t<turn>'), (2, '```json\n{"keywords": ["x<turn>"], "context": "c<conv>", "tags": []}\n```'), (3, "garbage <conv>"), (4, ""), (5, "KEYWORDS:\n- one<turn>\n- two\nTAGS: z")],
)
# worked out by hand: capitalised words come first among keywords
_FROM_CONTENT = ("ann,lake,one,saw,day", "Ann saw the Lake.", "ann,lake,one")
_PARSED = Fixture("id int, keywords string, context string, tags string", [(1, "<role>,tea", "A talk in <conv>.", "t<turn>"), (2, "x<turn>", "c<conv>", "x<turn>"), (3, *_FROM_CONTENT), (4, *_FROM_CONTENT), (5, "one<turn>,two", "Ann saw the Lake.", "z")])
_FILLED = lambda c: f"replace(replace(replace({c}, '<role>', role), '<conv>', CAST(conv_id AS VARCHAR)), '<turn>', CAST(turn AS VARCHAR)) AS {c}"


@query(f"SELECT conv_id, turn, {', '.join(map(_FILLED, ('keywords', 'context', 'tags')))} FROM {RESPONSES.sql} JOIN {_PARSED.sql} USING (id)")
def response_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's response to each turn, in JSON, sections or neither, against worked-out results."""
    said = F.replace(F.replace(F.replace("response", F.lit("<role>"), "role"), F.lit("<conv>"), F.col("conv_id").cast("string")), F.lit("<turn>"), F.col("turn").cast("string"))
    parsed = RESPONSES.deal(spark, sf_dir).select("conv_id", "turn", enrich.parse_analysis(said, F.lit("Ann saw the Lake. One day.")).alias("p"))
    return parsed.select("conv_id", "turn", F.array_join("p.keywords", ",").alias("keywords"), "p.context", F.array_join("p.tags", ",").alias("tags"))
