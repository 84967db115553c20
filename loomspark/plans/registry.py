"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; sql is the equivalent for DuckDB."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


#: A table of this size may lie in one row group, which is one task however costly its rows are; below it, there is little to deal.
SPREAD_FROM, SPREAD_TO = 256 << 10, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one is dealt out to all cores, a large one is read as its row groups lie."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if cores > 1 and SPREAD_FROM < size <= SPREAD_TO else rows


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, float):
        return f"CAST({value} AS DOUBLE)"  # a bare 0.9 is a decimal
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


class Fixture:
    """A few literal rows, the same for both engines."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.strip().split()[0] for c in schema.replace("array<string>", "list").split(",")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows) + f") AS f({', '.join(self.names)}))"


class Dealt(Fixture):
    """Rows dealt over all turns of all conversations: each turn gets one, by conv_id + turn, and its own text after the columns named in spoken."""

    def __init__(self, schema: str, rows: list[tuple], spoken: tuple[str, ...] = ()):
        super().__init__(schema, rows)
        self.spoken = spoken

    def deal(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        cards = self.frame(spark).toDF(*self.names)
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], f"_i long, {self.schema}")
        turns = table(spark, sf_dir, "conversations").withColumn("_i", (F.col("conv_id") + F.col("turn")) % len(self.rows))
        dealt = turns.join(F.broadcast(numbered), "_i")  # a few rows
        shown = [F.concat(c, F.lit(" "), F.coalesce("text", F.lit(""))).alias(c) if c in self.spoken else F.col(c) for c in cards.columns]
        return dealt.select("conv_id", "turn", "role", *shown)

    @property
    def sql(self) -> str:
        cards = "(VALUES " + ", ".join("(" + ", ".join(map(literal, (i, *r))) + ")" for i, r in enumerate(self.rows)) + f") AS f(_i, {', '.join(self.names)})"
        shown = ", ".join(f"f.{c} || ' ' || coalesce(c.text, '') AS {c}" if c in self.spoken else f"f.{c}" for c in self.names)
        return f"(SELECT c.conv_id, c.turn, c.role, {shown} FROM conversations c JOIN {cards} ON f._i = (c.conv_id + c.turn) % {len(self.rows)})"
