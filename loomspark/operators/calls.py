"""Model calls as a table: a response is stored under its prompt's hash and never asked for again.

A model's calls cost more than anything else in a run, and a plan that is read twice, a task
that is retried or a branch that shares a step would repeat them. So calls are a write: the
distinct prompts that the table lacks are asked once each, in waves that are each kept when
done, and every reader joins the stored responses. A run that broke off goes on from the
waves that were kept; a table that outlives the session serves the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources import scratch

Client = Callable[[str], str]
#: Distinct prompts of a wave at most, about.
WAVE = 20_000
_ROW = "call string, response string, error string, asked_at timestamp"


class CallTable:
    """Responses by the hash of model and prompt, in a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str, model: str = "", wave: int = WAVE):
        self.spark, self.path, self.model, self.wave = spark, path.rstrip("/"), model, wave

    def key(self, prompt):
        return F.sha2(F.concat(F.lit(self.model + "\n"), prompt), 256)

    def _rows(self) -> DataFrame:
        if not scratch.exists(self.spark, self.path):
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(f"{self.path}/wave-*")

    def responses(self) -> DataFrame:
        """call and response: of a call that two runs made at once, the earlier answer."""
        told = self._rows().where("response IS NOT NULL")
        return told.groupBy("call").agg(F.min_by("response", F.struct("asked_at", "response")).alias("response"))

    def failures(self) -> DataFrame:
        """error and n: how often calls failed, by kind of error; a failed call is made again the next time it is asked for."""
        return self._rows().where("response IS NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n"))

    def ask(self, prompts: DataFrame, factory: Callable[[], Client], prompt: str = "prompt") -> None:
        """Call the model once for each distinct prompt without a response; null prompts are not asked."""
        asked = prompts.select(F.col(prompt).alias("prompt")).where("prompt IS NOT NULL").distinct().withColumn("call", self.key(F.col("prompt")))
        new = scratch.materialise(asked.join(self.responses().select("call"), "call", "left_anti"), "prompts")
        waves = -(-new.count() // self.wave)
        for wave in range(waves):
            part = new.where(F.pmod(F.xxhash64("call"), F.lit(waves)) == wave)
            # a client is made once a task; rows are spread, since a call is slow and a small table lies in one task
            spread = part.repartition(max(1, min(self.spark.sparkContext.defaultParallelism, self.wave)), "call")
            spread.mapInPandas(_asking(factory), _ROW).write.parquet(f"{self.path}/wave-{uuid.uuid4().hex}")
        scratch.discard(new)

    def complete(self, rows: DataFrame, factory: Callable[[], Client], prompt: str = "prompt", out: str = "response") -> DataFrame:
        """rows with the response to each prompt, null where the call failed or there is no prompt; reading the result calls nothing."""
        self.ask(rows, factory, prompt)
        told = self.responses().select(F.col("call").alias("_call"), F.col("response").alias(out))
        keyed = rows.drop(out).withColumn("_call", self.key(F.col(prompt)))
        return keyed.join(told, "_call", "left").drop("_call")


def _asking(factory: Callable[[], Client]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for frame in frames:
            told, errors = [], []
            for text in frame["prompt"]:
                try:
                    client = client or factory()
                    answer, error = client(text), None
                except Exception as failure:
                    answer, error = None, type(failure).__name__
                told.append(answer)
                errors.append(error if answer is None and error else None if answer is not None else "NoResponse")
            yield pd.DataFrame({"call": frame["call"], "response": pd.Series(told, dtype=object), "error": pd.Series(errors, dtype=object), "asked_at": pd.Timestamp.now()})

    return run


@dataclass(frozen=True)
class Model:
    """A client's factory and the table that keeps its responses; takes a factory's place wherever one is asked for."""

    factory: Callable[[], Client]
    table: CallTable

    def __call__(self) -> Client:
        return self.factory()


def complete(rows: DataFrame, factory: Callable[[], Client], prompt: str = "prompt", out: str = "response") -> DataFrame:
    """rows with a model's response to each prompt, one call for each distinct prompt, made now and stored.

    A Model brings its own table; another factory gets one in the run's scratch folder.
    """
    if isinstance(factory, Model):
        return factory.table.complete(rows, factory.factory, prompt, out)
    spark = rows.sparkSession
    return CallTable(spark, scratch.fresh(spark, "calls")).complete(rows, factory, prompt, out)
