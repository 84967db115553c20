"""Domain trees over a sample's notes: overview, tree, annotation and routing. A model is a hook; without one the rules decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import enrich, parsers
from loomspark.operators.numbering import numbered

# The tree of a sample for which no model made one; limits of trees and annotations.
FALLBACK = [
    "Personal Life / Family / Relationships", "Personal Life / Identity / Self Expression", "Career Education / Work / Goals", "Health Wellbeing / Mental Health / Support",
    "Hobbies Interests / Arts Media / Entertainment", "Events Activities / Travel Meetings / Experiences", "Social Relationship / Friends / Conversation Partner",
    "Places Objects / Images / Visual Evidence", "Plans Decisions / Future Intentions / Commitments", "General Conversation / Episodic Turns / Miscellaneous",
]
MOST_DOMAINS, MOST_KEYWORDS, DESCRIPTION, OVERVIEW, TOP, BATCH, BRIEF = 36, 12, 500, 80, 3, 8, 260
ENTRY = "struct<path:string,description:string,keywords:array<string>>"


def fallback(name: str = "") -> list[tuple[str, str, list[str]]]:
    """path, description and keywords of the fallback tree; name stands in the descriptions."""
    return [(p, f"{name} memories related to {p.lower()}.".strip(), [w.lower() for w in p.replace("/", " ").split()[:6]]) for p in FALLBACK]


def fallback_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(fallback())], "place int, path string, description string, keywords array<string>")


def parse_tree(response: Column) -> Column:
    """Entries of a model's tree: normalised paths, each once, bounded; an empty array where there are none (then the fallback holds).

    The tree is an array under one of three names, or an object that holds it; its items are strings and objects in any mix, each object with
    its path under one of four names, and its keywords as a list or as one string. Other items are passed over. Read as variants, item by item.
    """
    tree = F.try_parse_json(parsers.json_object(response))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    get = lambda v, name, type_: F.try_variant_get(v, f"$.{name}", type_)

    def items(name: str) -> Column:
        held = get(tree, name, "variant")
        inner = F.when(kind(held).startswith("OBJECT"), get(held, "domains", "array<variant>")).otherwise(F.try_variant_get(held, "$", "array<variant>"))
        return F.when(F.size(inner) > 0, inner)

    def text(v: Column, *names: str) -> Column:
        said = [get(v, n, "variant") for n in names]
        return F.coalesce(*[F.when((kind(x) == "STRING") & (F.try_variant_get(x, "$", "string") != ""), F.try_variant_get(x, "$", "string")) for x in said])

    def keywords(v: Column) -> Column:
        one = lambda n: get(v, n, "variant")
        listed = lambda n: F.when(kind(one(n)) == "STRING", F.split(text(v, n), "[,;/]")).otherwise(get(v, n, "array<string>"))
        some = lambda n: F.when(F.size(listed(n)) > 0, listed(n))
        found = F.coalesce(some("keywords"), some("tags"), F.array().cast("array<string>"))
        return F.slice(F.filter(F.transform(found, lambda k: F.trim(F.coalesce(k, F.lit("None")))), lambda k: k != ""), 1, MOST_KEYWORDS)

    def entry(v: Column) -> Column:
        plain = kind(v) == "STRING"
        path = F.when(plain, F.try_variant_get(v, "$", "string")).otherwise(text(v, "path", "domain_path", "name", "title"))
        none = F.array().cast("array<string>")
        return F.struct(
            T.normalize_domain(path).alias("path"), F.substring(F.when(plain, "").otherwise(F.coalesce(text(v, "description", "summary"), F.lit(""))), 1, DESCRIPTION).alias("description"),
            F.when(plain, none).otherwise(keywords(v)).alias("keywords"),
        )

    named = F.coalesce(items("domains"), items("domain_tree"), items("tree"))
    usable = F.filter(named, lambda v: (kind(v) == "STRING") | kind(v).startswith("OBJECT"))
    found = F.coalesce(F.transform(usable, entry), F.array().cast(f"array<{ENTRY}>"))
    paths = F.transform(found, lambda x: x["path"])
    return F.slice(F.filter(found, lambda e, i: F.array_position(paths, e["path"]) == i + 1), 1, MOST_DOMAINS)


def overview(notes: DataFrame, most: int = OVERVIEW) -> DataFrame:
    """sample_id, line, brief: every step-th note of each sample, so that at most ``most`` lines stand for it. notes: sample_id, ord, brief.

    Places are counted over all tasks, so a sample of any size is no one task's work.
    """
    placed = numbered(notes.select("sample_id", "ord", "brief"), "sample_id", ["ord", "brief"], "_at")
    step = F.greatest(F.lit(1), F.floor(F.col("_at_of") / most))
    picked = placed.where((F.col("_at") % step == 0) & (F.col("_at") / step < most))
    return picked.select("sample_id", (F.col("_at") / step + 1).cast("int").alias("line"), "brief")


def tree_prompt(lines: DataFrame) -> DataFrame:
    """sample_id and prompt, from the overview's lines (OVERVIEW of a sample at most)."""
    text = lines.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("line", "brief"))).alias("l"))
    ask = 'Build a three-level domain tree for this conversation. Return JSON only: {"domains": [{"path": "Level 1 / Level 2 / Level 3", "description": "...", "keywords": ["..."]}]}\n\n'
    return text.select("sample_id", F.concat(F.lit(ask), F.array_join(F.transform("l", lambda x: x["brief"]), "\n")).alias("prompt"))


def trees(spark: SparkSession, notes: DataFrame, factory: Callable[[], enrich.Client] | None = None) -> DataFrame:
    """sample_id, place, path, description, keywords of each sample's tree: a model's, or the fallback where there is none."""
    plain = fallback_tree(spark)
    samples = notes.select("sample_id").distinct()
    if factory is None:
        return samples.crossJoin(F.broadcast(plain))  # ten rows
    said = enrich.complete(tree_prompt(overview(notes)), factory).select("sample_id", parse_tree(F.col("response")).alias("tree"))
    own = said.select("sample_id", F.posexplode("tree").alias("place", "e")).select("sample_id", "place", "e.*")
    bare = samples.join(own.select("sample_id").distinct(), "sample_id", "left_anti").crossJoin(F.broadcast(plain))  # ten rows
    return own.unionByName(bare)


def domain_text(path: Column, description: Column, keywords: Column) -> Column:
    return F.trim(F.concat_ws(" ", path, F.coalesce(description, F.lit("")), F.array_join(keywords, " ")))


def annotate(notes: DataFrame, tree: DataFrame, top: int = TOP) -> DataFrame:
    """note_id and domain_paths: the top domains of each note by cosine of token sets, ties to the larger path; the tree's first where nothing is shared.

    notes: sample_id, note_id, tokens. tree: sample_id, place, path, tokens. Tokens meet by an equi-join on sample and token.
    """
    words = tree.select("sample_id", "path", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    held = notes.select("sample_id", "note_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = held.join(words, ["sample_id", "token"]).groupBy("sample_id", "note_id", "path", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    scored = shared.withColumn("score", F.round(F.col("c") / F.sqrt(F.col("n").cast("double") * F.col("m")), 9))
    rank = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("score"), F.desc("path")))
    best = scored.withColumn("r", rank).where(F.col("r") <= top).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("r", "path"))).alias("p"))  # top rows
    first = tree.groupBy("sample_id").agg(F.min_by("path", "place").alias("first"))
    rows = notes.select("sample_id", "note_id").join(best, "note_id", "left").join(first, "sample_id", "left")
    return rows.select("note_id", F.coalesce(F.transform("p", lambda x: x["path"]), F.array(F.coalesce("first", F.lit(T.DEFAULT_DOMAIN)))).alias("domain_paths"))


def with_annotations(notes: DataFrame, given: DataFrame, tree: DataFrame, top: int = TOP) -> DataFrame:
    """note_id and domain_paths: a model's valid paths (given: sample_id, dia_id, paths) where there are any, the rest annotated by the rule."""
    valid = tree.select("sample_id", "path").distinct()
    said = given.select("sample_id", "dia_id", F.posexplode("paths").alias("i", "raw")).withColumn("path", T.normalize_domain(F.col("raw"))).join(valid, ["sample_id", "path"])
    listed = said.groupBy("sample_id", "dia_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "path"))), lambda x: x["path"])), 1, top).alias("said"))
    both = notes.join(listed, ["sample_id", "dia_id"], "left")
    told = both.where("said IS NOT NULL").select("note_id", F.col("said").alias("domain_paths"))
    rest = annotate(both.where("said IS NULL").drop("said"), tree, top)
    return told.unionByName(rest)


def annotation_prompts(notes: DataFrame, tree: DataFrame, size: int = BATCH) -> DataFrame:
    """sample_id, batch and prompt: the notes of each sample in order, so many to a prompt, under the sample's domains.

    notes: sample_id, ord, dia_id, brief; tree: sample_id, place, path, description.
    """
    placed = numbered(notes.select("sample_id", "ord", F.coalesce("dia_id", F.lit("")).alias("dia_id"), "brief"), "sample_id", ["ord", "dia_id"], "_at")
    line = F.concat(F.lit("- "), "dia_id", F.lit(": "), F.substring(F.coalesce("brief", F.lit("")), 1, BRIEF))
    groups = placed.groupBy("sample_id", F.floor(F.col("_at") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("_at", line.alias("l")))).alias("l"))  # size rows
    paths = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), "path", F.lit(": "), F.coalesce("description", F.lit(""))).alias("l"))))  # MOST_DOMAINS rows
    listed = tree.groupBy("sample_id").agg(F.array_join(F.transform(paths, lambda x: x["l"]), "\n").alias("valid"))
    ask = 'Assign each memory one to three of the valid domain paths. Return JSON only: {"annotations": [{"dia_id": "...", "domain_paths": ["..."]}]}\n\nValid domain paths:\n'
    return groups.join(listed, "sample_id").select("sample_id", "batch", F.concat(F.lit(ask), "valid", F.lit("\n\nMemories:\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("prompt"))


def said_annotations(responses: DataFrame, tree: DataFrame, top: int = TOP) -> DataFrame:
    """sample_id, dia_id and paths that responses (sample_id, batch, response) name: normalised, valid, each once, top at most; of a note named twice the last item counts.

    An item's paths are a list or one string, under either of two names, as the items are.
    """
    item = "array<struct<dia_id:string,domain_paths:string,domains:string>>"
    said = F.from_json(parsers.json_object(F.col("response")), f"annotations {item}, memories {item}")
    items = F.when(F.size(said["annotations"]) > 0, said["annotations"]).otherwise(said["memories"])
    rows = responses.select("sample_id", "batch", F.posexplode(items).alias("i", "x")).select("sample_id", "batch", "i", F.trim("x.dia_id").alias("dia_id"), "x.domain_paths", "x.domains")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")).isin("", "[]", "null")
    raw = F.when(blank(F.col("domain_paths")), F.col("domains")).otherwise(F.col("domain_paths"))
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    named = rows.where("dia_id <> ''").select("sample_id", "batch", "i", "dia_id", F.posexplode(listed).alias("j", "raw")).withColumn("path", T.normalize_domain(F.col("raw")))
    valid = named.join(tree.select("sample_id", "path").distinct(), ["sample_id", "path"], "left_semi")
    each = valid.groupBy("sample_id", "dia_id", "batch", "i").agg(F.array_sort(F.collect_list(F.struct("j", "path"))).alias("p"))  # an item's paths
    kept = each.select("sample_id", "dia_id", "batch", "i", F.slice(F.array_distinct(F.transform("p", lambda x: x["path"])), 1, top).alias("paths"))
    return kept.groupBy("sample_id", "dia_id").agg(F.max_by("paths", F.struct("batch", "i")).alias("paths"))


def annotate_with_model(notes: DataFrame, tree: DataFrame, factory: Callable[[], enrich.Client], top: int = TOP) -> DataFrame:
    """note_id and domain_paths: a model's, asked for eight notes at a time, and the rule's for the notes that no valid answer names.

    notes: sample_id, note_id, ord, dia_id, brief, tokens; tree: sample_id, place, path, description, tokens.
    """
    said = enrich.complete(annotation_prompts(notes, tree), factory)
    return with_annotations(notes, said_annotations(said, tree, top), tree, top)


def reroute(candidates: DataFrame, factory: Callable[[], enrich.Client] | None = None, most: int = TOP) -> DataFrame:
    """query_id and domains: ranked candidates (query_id, query, domain, score, rank), in a model's order where there is a model that names valid ones."""
    listed = candidates.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "domain", "score"))).alias("c"))  # the routes of a question, a few
    rows = listed.select("query_id", "query", F.transform("c", lambda x: x["domain"]).alias("valid"), "c")
    if factory is None:
        return rows.select("query_id", F.slice("valid", 1, most).alias("domains"))
    lines = F.array_join(F.transform("c", lambda x: F.concat((x["rank"] - 1).cast("string"), F.lit(". "), x["domain"], F.lit(" (score="), F.round(x["score"], 4).cast("string"), F.lit(")"))), "\n")
    asked = rows.withColumn("prompt", F.concat(F.lit("Order the domains that fit the text. Answer with DOMAINS: and REASON:.\nText: "), "query", F.lit("\n"), lines))
    said = enrich.complete(asked, factory)
    return said.select("query_id", F.when(F.col("response").isNull(), F.slice("valid", 1, most)).otherwise(parsers.domain_rerank(F.col("response"), F.col("valid"), most)["domains"]).alias("domains"))
