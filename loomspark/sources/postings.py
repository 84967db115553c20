"""A persisted inverted index: postings bucketed by token, kept up by deltas, with bounds to skip chunks.

``postings`` holds a row for each token of each note, bucketed by token, so that a join by
token reads it as it lies: questions move, notes don't. ``frequencies`` (token, how many notes),
``totals`` (notes and tokens in all) and ``bounds`` (for each token and chunk of notes the
least length of a note that holds it) are deltas: an append adds rows to each table, and sums
and minima over them are those of all notes. A token's contribution to BM25 falls with the
note's length, so the least length gives the most that a chunk's notes can get from a token;
with the sum over a question's tokens below what its k-th best note has, the chunk is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import retrieval as R

#: Chunks of each question that are scored first, to learn what its k-th best note has at least.
FIRST = 2


class Postings:
    """An index of notes at a path, under a table name in the session's catalog."""

    def __init__(self, spark: SparkSession, path: str, name: str, note_id: str = "long", buckets: int | None = None, chunk: Column | None = None, chunks: int = 64):
        """chunk (over note_id) says which notes lie together; by default a hash deals them to so many chunks. buckets must be the same whenever the index is opened."""
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.chunk = F.pmod(F.xxhash64("note_id"), F.lit(chunks)) if chunk is None else chunk
        shape = {"postings": f"token STRING, note_id {note_id}, dl INT, chunk BIGINT", "frequencies": "token STRING, df BIGINT", "bounds": "token STRING, chunk BIGINT, dl INT"}
        for table, columns in shape.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({columns}) USING parquet CLUSTERED BY (token) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_totals (notes BIGINT, tokens BIGINT) USING parquet LOCATION '{self.path}/totals'")

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def append(self, notes: DataFrame) -> None:
        """Add notes (note_id, tokens: a set). The rows of a note that is there already are added again: an index is rebuilt to change a note."""
        rows = notes.select("note_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).select("token", "note_id", "dl", self.chunk.cast("long").alias("chunk"))
        dealt = rows.repartition(self.buckets, "token")
        dealt.write.insertInto(f"{self.name}_postings")
        rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).write.insertInto(f"{self.name}_frequencies")
        rows.groupBy("token", "chunk").agg(F.min("dl").alias("dl")).repartition(self.buckets, "token").write.insertInto(f"{self.name}_bounds")
        notes.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("tokens")).write.insertInto(f"{self.name}_totals")

    def build(self, notes: DataFrame) -> None:
        """The index of these notes alone."""
        for kind in ("postings", "frequencies", "bounds", "totals"):
            self.spark.createDataFrame([], self.table(kind).schema).write.insertInto(f"{self.name}_{kind}", overwrite=True)
        self.append(notes)

    def drop(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        for kind in ("postings", "frequencies", "bounds", "totals"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def terms(self, questions: DataFrame) -> DataFrame:
        """query_id, token, idf and avgdl of each token of the questions (query_id, tokens) that some note holds."""
        asked = questions.select("query_id", F.explode("tokens").alias("token"))
        df = self.table("frequencies").join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df"))
        stats = self.table("totals").agg(F.sum("notes").alias("n_docs"), (F.sum("tokens") / F.sum("notes")).alias("avgdl"))
        idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(df.crossJoin(F.broadcast(stats)).select("token", idf.alias("idf"), "avgdl"), "token")  # one row

    def bm25(self, questions: DataFrame) -> DataFrame:
        """query_id, note_id, score of every pair that shares a token; the postings are joined where they lie."""
        hits = self.table("postings").join(self.terms(questions), "token")
        return hits.groupBy("query_id", "note_id").agg(F.sum(_part()).alias("score"))

    def limits(self, questions: DataFrame) -> DataFrame:
        """query_id, chunk and most: what no note of the chunk can exceed."""
        least = self.table("bounds").groupBy("token", "chunk").agg(F.min("dl").alias("dl"))
        return least.join(self.terms(questions), "token").groupBy("query_id", "chunk").agg(F.sum(_part()).alias("most"))

    def top_k(self, questions: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """The k best notes of each question, as retrieval.top_k of bm25 gives them, and what was scored: query_id, chunk, most, scored.

        The chunks of largest bounds are scored first; what their k-th best note has is a floor, and of the others only those are scored whose
        bound reaches it. So nothing that could be among the k best is left out.
        """
        order = Window.partitionBy("query_id").orderBy(F.desc("most"), "chunk")
        limits = self.limits(questions).withColumn("_r", F.row_number().over(order))
        terms = self.terms(questions)
        postings = self.table("postings")

        def scored(wanted: DataFrame) -> DataFrame:
            hits = postings.join(terms, "token").join(wanted.select("query_id", "chunk"), ["query_id", "chunk"], "left_semi")
            return hits.groupBy("query_id", "note_id").agg(F.sum(_part()).alias("score"))

        first = R.top_k(scored(limits.where(F.col("_r") <= FIRST)), k, digits=digits)
        floor = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        slack = 10.0**-digits  # scores are compared rounded
        judged = limits.join(floor, "query_id", "left").withColumn("scored", (F.col("_r") <= FIRST) | F.col("floor").isNull() | (F.col("most") >= F.col("floor") - slack))
        rest = scored(judged.where(F.col("scored") & (F.col("_r") > FIRST)))
        best = R.top_k(first.drop("rank").unionByName(rest), k, digits=digits)
        return best, judged.select("query_id", "chunk", "most", "scored")


def _part() -> Column:
    """A token's contribution to a note's score; it falls with the note's length."""
    return F.col("idf") * (R.K1 + 1.0) / (1.0 + R.K1 * (1.0 - R.B + R.B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-6))))
