"""Inference that can be resumed: answers are stored by prompt, and only what is not stored is asked.

The store is an append-only Parquet folder of ``(prompt_digest, model, answer, error)``. A prompt that the
model has answered is never asked again, whoever asks; a failed call leaves a row with its error, and the
prompt is asked anew in the next run, up to ``attempts`` times. Tasks append when they end: if an executor
is lost, only the calls of its unfinished tasks are repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STORE_SCHEMA = "prompt_digest string, model string, answer string, error string"
ATTEMPTS = 3
IN_FLIGHT = 8

Model = Callable[[list[str]], list[dict]]


def digest(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def stored_answers(spark: SparkSession, store: str, model: str) -> DataFrame:
    """``(prompt_digest, answer, tries)`` of every prompt that was asked; the answer is null if all calls failed."""
    try:
        rows = spark.read.schema(STORE_SCHEMA).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORE_SCHEMA)
    return (
        rows.where(F.col("model") == model)
        .groupBy("prompt_digest")
        .agg(F.max("answer").alias("answer"), F.count("*").alias("tries"))
    )


def pending(prompts: DataFrame, store: str, model: str, attempts: int = ATTEMPTS) -> DataFrame:
    """``(prompt_digest, prompt)``: each distinct prompt that has no answer yet and calls left."""
    settled = stored_answers(prompts.sparkSession, store, model).where(
        F.col("answer").isNotNull() | (F.col("tries") >= attempts)
    )
    return (
        prompts.where(F.col("prompt").isNotNull())
        .groupBy(digest(F.col("prompt")).alias("prompt_digest"))
        .agg(F.any_value("prompt").alias("prompt"))
        .join(settled, "prompt_digest", "left_anti")
    )


def ask(
    prompts: DataFrame,
    make_model: Callable[[], Model],
    store: str,
    model: str,
    attempts: int = ATTEMPTS,
    batch: int = 1,
    in_flight: int = IN_FLIGHT,
) -> None:
    """One run: ask what is pending and append answers and failures to the store.

    ``make_model`` is called once a task. A call holds at most ``batch`` prompts and at most ``in_flight`` calls of
    a task run at once; a call that raises fails for its prompts only.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer_all = make_model()

        def call(piece: pd.DataFrame) -> list[tuple[str | None, str | None]]:
            try:
                found = answer_all(piece["prompt"].tolist())
                if len(found) != len(piece):
                    raise ValueError(f"{len(found)} answers to {len(piece)} prompts")
                return [(json.dumps(a), None) for a in found]
            except Exception as error:  # a provider may raise anything; the row tells what
                return [(None, f"{type(error).__name__}: {error}")] * len(piece)

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                for start in range(0, len(frame), batch * in_flight):
                    held = frame.iloc[start : start + batch * in_flight]
                    pieces = [held.iloc[k : k + batch] for k in range(0, len(held), batch)]
                    answers = list(chain.from_iterable(pool.map(call, pieces)))
                    yield pd.DataFrame(
                        {
                            "prompt_digest": held["prompt_digest"].tolist(),
                            "model": model,
                            "answer": [a for a, _ in answers],
                            "error": [e for _, e in answers],
                        }
                    )

    asked = pending(prompts, store, model, attempts).mapInPandas(run, STORE_SCHEMA)
    asked.write.mode("append").parquet(store)


def answered(prompts: DataFrame, store: str, model: str, schema: str) -> DataFrame:
    """``prompts`` with the fields of ``schema`` from the stored answers, ``tries``, and ``complete``.

    Prompts without an answer keep their row, with null fields.
    """
    found = stored_answers(prompts.sparkSession, store, model).withColumn("_a", F.from_json("answer", schema))
    rows = prompts.withColumn("prompt_digest", digest(F.col("prompt"))).join(found, "prompt_digest", "left")
    return rows.select(
        *prompts.columns,
        "_a.*",
        F.coalesce("tries", F.lit(0)).alias("tries"),
        F.col("answer").isNotNull().alias("complete"),
    )
