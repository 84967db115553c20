"""Notes of largest token overlap, exact, without a row for every pair that shares a common token.

A token that few notes of a sample hold makes few pairs: those are joined and counted. A
token that many hold would make the square of their number. What notes share by common
tokens alone depends only on which common tokens each holds and how many tokens it has, so
notes that agree in both are one class: of a class only its first k notes can matter, and
classes, not notes, are compared over common tokens. A pair that shares rare tokens too is
met by the join with its full overlap, which is never less than what its classes say, so
the better of the two is the pair's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources import scratch

#: Notes of a sample that may hold a token before it counts as common; copies of each common token's row, so that its notes are divided among tasks.
RARE, SALTS = 200, 16


def _parted(rows: DataFrame, common: DataFrame, key: str) -> DataFrame:
    """rows with their common and rare tokens apart. A row is a note of some tokens; the two lists together are its set."""
    flat = rows.select("sample_id", key, F.explode("tokens").alias("token"), F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("_salt"))
    told = flat.join(common, ["sample_id", "token", "_salt"], "left")
    lists = told.groupBy("sample_id", key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_common"), F.col("token")))).alias("common"), F.collect_list(F.when(F.col("_common").isNull(), F.col("token"))).alias("rare")
    )  # a note's own tokens
    return rows.select("sample_id", key, "ord", F.size("tokens").alias("size")).join(lists, ["sample_id", key])


def nearest(asked: DataFrame, held: DataFrame, k: int, earlier: bool = False, rare: int = RARE) -> DataFrame:
    """sample_id, ask_id, note_id, overlap (rounded to 9 places) and place: of the held notes of the sample that share a token, the k of largest Jaccard overlap, the smaller ord first.

    asked: sample_id, ask_id, ord, tokens (set); held: sample_id, note_id, ord, tokens, or asked itself. With earlier only notes of smaller
    ord count. Within a sample an ord names one note. Token lists are written once.
    """
    often = held.select("sample_id", F.explode("tokens").alias("token")).groupBy("sample_id", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rare)
    common = often.select("sample_id", "token", F.lit(True).alias("_common"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    mine = scratch.materialise(_parted(asked, common, "ask_id"), "asked-tokens")
    theirs = mine.withColumnRenamed("ask_id", "note_id") if held is asked else scratch.materialise(_parted(held, common, "note_id"), "held-tokens")
    jaccard = lambda c, a, b: F.round(c / (F.col(a) + F.col(b) - c), 9)
    left = mine.select("sample_id", "ask_id", F.col("ord").alias("ask_ord"), F.col("size").alias("ask_size"), F.col("common").alias("ask_common"), F.explode("rare").alias("token"))
    right = theirs.select("sample_id", "note_id", "ord", "size", "common", F.explode("rare").alias("token"))
    pairs = left.join(right, ["sample_id", "token"])
    if earlier:
        pairs = pairs.where("ord < ask_ord")
    shared = F.count(F.lit(1)) + F.size(F.array_intersect(F.first("ask_common"), F.first("common")))
    met = pairs.groupBy("sample_id", "ask_id", "note_id").agg(shared.alias("both"), F.first("ask_size").alias("ask_size"), F.first("size").alias("size"), F.first("ord").alias("ord"))
    by_rare = met.select("sample_id", "ask_id", "note_id", "ord", jaccard(F.col("both"), "ask_size", "size").alias("overlap"))

    order = F.row_number().over(Window.partitionBy("sample_id", "ask_id").orderBy(F.desc("overlap"), "ord"))
    if mine.where(F.size("common") > 0).isEmpty():  # then rare tokens are all that is shared
        return by_rare.withColumn("place", order).where(F.col("place") <= k).select("sample_id", "ask_id", "note_id", "overlap", "place")
    # classes of notes that hold the same common tokens and as many in all; of the held ones the first k stand for the class
    place = F.row_number().over(Window.partitionBy("sample_id", "common", "size").orderBy("ord"))
    kept = theirs.where(F.size("common") > 0).withColumn("_r", place).where(F.col("_r") <= k)
    groups = kept.groupBy("sample_id", "common", "size").agg(F.array_sort(F.collect_list(F.struct("ord", "note_id"))).alias("members"))  # k notes
    kinds = mine.where(F.size("common") > 0).select("sample_id", F.col("common").alias("ask_common"), F.col("size").alias("ask_size")).distinct()
    words = lambda df, c: df.withColumn("token", F.explode(c))
    alike = words(kinds, "ask_common").join(words(groups, "common"), ["sample_id", "token"]).groupBy("sample_id", "ask_common", "ask_size", "common", "size").agg(F.count(F.lit(1)).alias("both"), F.first("members").alias("members"))
    ranked = alike.select("sample_id", "ask_common", "ask_size", jaccard(F.col("both"), "ask_size", "size").alias("overlap"), "members")
    askers = mine.where(F.size("common") > 0).select("sample_id", "ask_id", F.col("ord").alias("ask_ord"), F.col("common").alias("ask_common"), F.col("size").alias("ask_size"))
    told = ranked.select("sample_id", "ask_common", "ask_size", "overlap", F.explode("members").alias("m")).select("sample_id", "ask_common", "ask_size", "overlap", "m.ord", "m.note_id")
    if not earlier:
        # the same k notes are best for all askers of a class
        best = F.row_number().over(Window.partitionBy("sample_id", "ask_common", "ask_size").orderBy(F.desc("overlap"), "ord"))
        told = told.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")
    else:
        # a note is of use to some asker only if fewer than k notes are both better and earlier; for one note that is a falling staircase
        sooner = F.min("ord").over(Window.partitionBy("sample_id", "ask_common", "ask_size").orderBy(F.desc("overlap"), "ord").rowsBetween(Window.unboundedPreceding, -1))
        told = told.withColumn("_s", sooner).where("_s IS NULL OR ord < _s").drop("_s") if k == 1 else told
    by_class = askers.join(told, ["sample_id", "ask_common", "ask_size"])
    if earlier:
        by_class = by_class.where("ord < ask_ord")
    both = by_rare.unionByName(by_class.select(*by_rare.columns)).groupBy("sample_id", "ask_id", "note_id").agg(F.first("ord").alias("ord"), F.max("overlap").alias("overlap"))
    return both.withColumn("place", order).where(F.col("place") <= k).select("sample_id", "ask_id", "note_id", "overlap", "place")
