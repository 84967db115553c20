"""From retrieved notes to answers: block rankings, date answers, evidence lists, and the question pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import dates
from loomspark.functions import text as T
from loomspark.operators import enrich, parsers

# What in an evidence block speaks for an answer of each slot type.
CUES = {
    "book": ["book", "books", "read", "novel", "story", "title", "recommended", "suggested"],
    "place": ["where", "place", "moved", "camped", "camp", "beach", "mountain", "forest", "country", "city", "home", "park", "trail", "lake"],
    "person": ["who", "friend", "friends", "kid", "kids", "children", "support", "supports"],
    "event": ["event", "events", "participated", "attended", "joined", "pride", "parade", "conference", "poetry", "reading", "school", "council", "meeting", "group", "community"],
    "activity": ["activity", "activities", "destress", "hike", "hiking", "camp", "camping", "paint", "painting", "pottery", "swim", "swimming", "run", "running", "violin", "clarinet", "family"],
    "item": ["paint", "painted", "painting", "art", "pottery", "symbol", "symbols", "item", "items", "instrument", "instruments", "pet", "pets", "name", "names", "change", "changes", "type", "types", "bought", "made"],
    "count": ["time", "times", "once", "twice", "three", "four", "number", "count"],
    "status": ["identity", "relationship", "status", "career", "path", "decided", "transition"],
    "fact": [],
}
EVIDENCE_BLOCKS = 8


def temporal_score(question: Column, response: Column, main: Column, metadata: Column) -> Column:
    """Tokens of question and response found in a block's text and metadata, weighted. The texts are token sets."""
    return 3 * T.n_common(question, main) + T.n_common(question, metadata) + 2 * T.n_common(response, main) + T.n_common(response, metadata)


def temporal_blocks(blocks: DataFrame) -> DataFrame:
    """blocks that may date a question, with score and place: those within 2 of the best, if that has 3 or more.

    blocks: query_id, ord, question, response, content, speaker, image_caption, image_query, dia_id.
    """
    words = lambda *c: T.overlap_tokens(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in c]))
    split = blocks.withColumns({"_q": words("question"), "_r": words("response"), "_m": words("content", "speaker"), "_d": words("image_caption", "image_query", "dia_id")})
    scored = split.withColumn("score", temporal_score(F.col("_q"), F.col("_r"), F.col("_m"), F.col("_d"))).drop("_q", "_r", "_m", "_d")
    best = F.max("score").over(Window.partitionBy("query_id"))
    kept = scored.withColumn("_best", best).where((F.col("_best") >= 3) & (F.col("score") >= F.greatest(F.lit(3), F.col("_best") - 2))).drop("_best")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")))


def resolve_dates(blocks: DataFrame) -> DataFrame:
    """query_id, response and answer: dates by the ranked blocks of each question, or by all in order where none ranks.

    blocks: as temporal_blocks takes them, with session_date (text). The first block that offers a candidate decides;
    a relative answer is made absolute by the first ranked block whose rule changes it.
    """
    ranked = temporal_blocks(blocks)
    some = ranked.select("query_id").distinct().withColumn("_some", F.lit(True))
    all_ = blocks.join(some, "query_id", "left").select("*", F.col("ord").alias("place")).where("_some IS NULL").drop("_some").withColumn("ranked", F.lit(False))
    used = ranked.drop("score").withColumn("ranked", F.lit(True)).unionByName(all_)
    date = dates.session_date(F.col("session_date"))
    offered = F.try_element_at(dates.temporal_candidates(date, F.col("content"), F.col("question")), F.lit(1))
    changed = dates.normalize_answer(F.coalesce("response", F.lit("")), date, F.col("content"))
    told = used.select("query_id", "response", "place", offered.alias("offer"), F.when(F.col("ranked") & (changed != F.coalesce("response", F.lit(""))), changed).alias("changed"))
    one = told.groupBy("query_id").agg(
        F.first("response").alias("response"),
        F.min(F.when(F.col("offer").isNotNull(), F.struct("place", F.col("offer.answer").alias("answer"), F.col("offer.style").alias("style")))).alias("offer"),
        F.min(F.when(F.col("changed").isNotNull(), F.struct("place", F.col("changed").alias("answer")))).alias("normal"),
    )
    response = F.coalesce("response", F.lit(""))
    normal = F.coalesce("normal.answer", response)
    final = F.when(dates.is_uncertain(response), F.col("offer.answer")).otherwise(normal)
    anchored = F.col("offer.style").isin("anchored_relative", "duration_since", "duration", "year", "month_year")
    answer = F.when(F.col("offer").isNull(), normal).when((final == response) & anchored, F.col("offer.answer")).otherwise(final)
    return one.select("query_id", "response", answer.alias("answer"))


def evidence_blocks(blocks: DataFrame, most: int = EVIDENCE_BLOCKS, ascii_borders: bool = False) -> DataFrame:
    """The best evidence blocks of each question with slot_type, cue_hits, score and place.

    blocks: query_id, ord, question, speaker, content, image_caption, image_query (and what else they carry).
    """
    kind = T.slot_type(F.col("question"), ascii_borders=ascii_borders)
    cues = F.coalesce(*[F.when(F.col("slot_type") == k, F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")) for k, v in CUES.items()])
    fact = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("speaker", "content", "image_caption", "image_query")])
    split = blocks.withColumns({"slot_type": kind, "_low": F.lower(fact), "_fact": T.overlap_tokens(fact), "_q": T.overlap_tokens(F.col("question"))})
    hit = split.withColumn("cue_hits", F.array_sort(F.filter(cues, lambda c: F.col("_low").contains(c))))
    scored = hit.withColumn("score", 3 * T.n_common(F.col("_q"), F.col("_fact")) + 2 * F.size("cue_hits") + F.least(F.lit(3), F.size("_fact"))).where("score > 0").drop("_low", "_fact", "_q")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))).where(F.col("place") <= most)


def evidence_list(ranked: DataFrame) -> DataFrame:
    """query_id, n_blocks and evidence: the ranked blocks as a numbered text. ranked also has dia_id and session_date."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    text = F.concat_ws(
        "\n", F.concat(F.lit("[Evidence "), "place", F.lit("]")), F.concat(F.lit("dia_id: "), F.when(F.coalesce("dia_id", F.lit("")) != "", F.col("dia_id")).otherwise("unknown")),
        F.concat(F.lit("slot_type: "), "slot_type"), line("session_date", F.col("session_date")), line("speaker", F.col("speaker")), F.concat(F.lit("raw_fact: "), F.trim(F.coalesce("content", F.lit("")))),
        line("image_caption", F.col("image_caption")), line("image_query", F.col("image_query")), line("matched_slot_cues", F.array_join("cue_hits", ", ")),
    )
    listed = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_sort(F.collect_list(F.struct("place", text.alias("t")))).alias("found"))  # EVIDENCE_BLOCKS at most
    return listed.select("query_id", "n_blocks", F.array_join(F.transform("found", lambda x: x["t"]), "\n\n").alias("evidence"))


def refined(initial: Column, said: Column, n_blocks: Column) -> Column:
    """A model's revision, unless it is a bare label or takes away an answer that evidence supports."""
    new, old = F.trim(parsers.answer(said)), F.trim(parsers.answer(initial))
    low = F.lower(new)
    label = low.isin("", "final short answer", "final short answer:", "short answer", "short answer:")
    erased = (n_blocks > 0) & (old != "") & low.contains("not mentioned")
    kept = F.when(label | erased, old).otherwise(new)
    return F.when((n_blocks > 0) & said.isNotNull(), F.when(kept != "", kept).otherwise(initial)).otherwise(initial)


def gold_debug(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each gold id of a question with its candidate's columns, and whether it was among the kept candidates."""
    found = candidates.withColumn("found_in_candidate_debug", F.lit(True))
    return gold.join(found, ["query_id", "dia_id"], "left").withColumn("found_in_candidate_debug", F.coalesce("found_in_candidate_debug", F.lit(False)))


def relation_counts(contexts: DataFrame, key: str, context: str) -> DataFrame:
    """How often each relation occurs in each context."""
    return contexts.select(key, F.explode(parsers.relation_names(F.col(context))).alias("relation")).groupBy(key, "relation").agg(F.count(F.lit(1)).alias("n"))


def context_of(bundle: DataFrame) -> DataFrame:
    """query_id and context: the notes of each bundle in order. bundle: query_id, block_pos, relation, date, content; ten blocks at most."""
    shown = F.when(F.col("relation") != "primary", F.col("relation"))
    block = parsers.context_block(F.col("date"), F.col("content"), shown)
    listed = bundle.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("block_pos", block.alias("b")))).alias("blocks"))
    return listed.select("query_id", F.array_join(F.transform("blocks", lambda x: x["b"]), "").alias("context"))


def context_table(contexts: DataFrame) -> DataFrame:
    """The blocks of formatted contexts as rows that the rankings take. contexts: query_id, question, response, context."""
    rows = contexts.select("query_id", "question", "response", F.posexplode(parsers.context_blocks(F.col("context"))).alias("ord", "b"))
    body = F.regexp_extract(F.col("b.content"), r"(?s)^(.*?)(?: memory context:.*)?\z", 1)
    with_fields = rows.select("query_id", "question", "response", "ord", F.col("b.date").alias("date"), F.col("b.content").alias("raw"), T.note_fields(body).alias("f"))
    field = lambda n: F.coalesce(F.col("f")[n], F.lit(""))
    return with_fields.select(
        "query_id", "question", "response", "ord", "raw", F.coalesce(F.col("f")["content"], F.col("raw")).alias("content"), field("speaker").alias("speaker"), field("dia_id").alias("dia_id"),
        F.when(field("session_date") != "", field("session_date")).otherwise(F.col("date")).alias("session_date"), field("image_caption").alias("image_caption"), field("image_query").alias("image_query"),
    )


def prompt(question: Column, context: Column) -> Column:
    """The answer prompt: what the question's type asks for, the context, the question."""
    kind = T.answer_type(question)
    return F.concat(
        F.lit("Answer the question from the context alone, as short as it can be.\nAnswer type: "), kind, F.lit("\nFormat: "), parsers.instruction(kind), F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nShort answer:")
    )


def answer_questions(contexts: DataFrame, factory: Callable[[], enrich.Client]) -> DataFrame:
    """query_id, category, answer: a model's answers (enrich.complete), dates resolved, category-1 answers revised over their evidence.

    contexts: query_id, category, question, context.
    """
    asked = enrich.complete(contexts.withColumn("prompt", prompt(F.col("question"), F.col("context"))), factory).withColumn("response", F.trim(parsers.answer(F.col("response"))))
    blocks = context_table(asked)
    temporal = resolve_dates(blocks.withColumn("content", F.col("raw"))).select("query_id", F.col("answer").alias("dated"))
    lists = evidence_list(evidence_blocks(blocks))
    both = asked.join(temporal, "query_id", "left").join(lists, "query_id", "left")
    kind = T.answer_type(F.col("question"))
    first = both.withColumn("initial", F.when((kind == "temporal") & F.col("dated").isNotNull(), F.col("dated")).otherwise(F.col("response")))
    revise = F.concat(F.lit("Revise the short answer; keep every item that the evidence supports.\nQuestion: "), "question", F.lit("\nInitial answer: "), F.coalesce("initial", F.lit("")), F.lit("\nEvidence:\n"), "evidence", F.lit("\nFinal short answer:"))
    wanted = first.where((F.col("category") == 1) & (F.col("n_blocks") > 0)).withColumn("prompt", revise).drop("response")
    said = enrich.complete(wanted.select("query_id", "prompt"), factory).select("query_id", F.col("response").alias("said"))
    done = first.join(said, "query_id", "left")
    return done.select("query_id", "category", F.when(F.col("category") == 1, refined(F.col("initial"), F.col("said"), F.coalesce("n_blocks", F.lit(0)))).otherwise(F.col("initial")).alias("answer"))
