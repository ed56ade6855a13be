"""Extension points for scorers that need models or services: by default values come from a table, or are zero."""

from __future__ import annotations

import asyncio
import inspect
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.io import exists

#: Texts shorter than this are not scored.
LEAST_CHARACTERS = 2


def table_scores(rows: DataFrame, scores: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Scores looked up by key; missing ones are null."""
    return rows.join(scores.select(key, *attributes), key, "left")


def score_with(rows: DataFrame, text: str, key: str, attributes: list[str], scorer: Callable[[pd.Series], pd.DataFrame], most_characters: int | None = None) -> DataFrame:
    """Scores of a function over batches of texts (pandas). Where a batch fails its texts are scored one by one; one that fails has nulls and the message in `error`.

    most_characters: a limit that a service sets for its texts; without it texts are scored whole.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}" + "".join(f", `{a}` double" for a in attributes) + ", error string"
    least = LEAST_CHARACTERS

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            texts = batch[text].fillna("").str.slice(0, most_characters)
            out = pd.DataFrame({key: batch[key], **{a: float("nan") for a in attributes}, "error": None})
            fine = texts.index[texts.str.len() >= least]
            try:
                out.loc[fine, attributes] = scorer(texts[fine])[attributes].to_numpy()
            except Exception:  # a service's fault is data here: the row stays, with its message
                for i in fine:
                    try:
                        out.loc[[i], attributes] = scorer(texts[[i]])[attributes].to_numpy()
                    except Exception as e:
                        out.loc[i, "error"] = str(e)
            yield out

    return rows.select(key, text).mapInPandas(run, schema)


def zero_scores(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """What scorers that are not installed give."""
    return rows.withColumns({a: F.lit(0.0) for a in attributes})


def annotation_prompt(text: Column, codebook: str, examples: Sequence[tuple[str, dict]] = ()) -> dict[str, Column]:
    """The columns system (the codebook and its worked examples) and user (the message) of a request."""
    shown = "\n\n".join(f"Message: {message}\nAnswer: {json.dumps(labels)}" for message, labels in examples)
    system = codebook + ("\n\n---\n\n## Examples\n\n" + shown if examples else "")
    return {"system": F.lit(system), "user": F.concat(F.lit("Message: "), F.coalesce(text, F.lit("")), F.lit("\nAnswer:"))}


def call_bounded(rows: DataFrame, text: str, key: str, attributes: list[str], call: Callable, concurrency: int = 8, tries: int = 3, waits: Sequence[float] = (0.5, 2.0), most_seconds: float = 120.0) -> DataFrame:
    """(key, attributes, error, tries): the answers of a service to each text, at most `concurrency` calls at a time in a task.

    call: a function, or a coroutine function, from a text to a dict of numbers. A call that raises, or takes over most_seconds, is made again
    after waits[0], waits[1] ... seconds (the last one from then on), `tries` times in all; then the row has nulls and the last message.
    Every row gives one row; null texts are empty ones.
    """
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}" + "".join(f", `{a}` double" for a in attributes) + ", error string, tries int"

    async def answered(value: str, gate: asyncio.Semaphore) -> tuple:
        error = None
        for attempt in range(1, tries + 1):
            async with gate:
                try:
                    made = call(value) if inspect.iscoroutinefunction(call) else asyncio.to_thread(call, value)
                    found = await asyncio.wait_for(made, most_seconds)
                    return (*(None if found.get(a) is None else float(found[a]) for a in attributes), None, attempt)
                except Exception as e:  # a service's fault is data here: the row stays, with its message
                    error = str(e) or type(e).__name__
            if attempt < tries and waits:
                await asyncio.sleep(waits[min(attempt, len(waits)) - 1])
        return (*[None] * len(attributes), error, tries)

    async def all_of(values: list[str]) -> list[tuple]:
        gate = asyncio.Semaphore(concurrency)
        return await asyncio.gather(*(answered(v, gate) for v in values))

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            out = pd.DataFrame(asyncio.run(all_of(batch[text].fillna("").tolist())), columns=[*attributes, "error", "tries"])
            out.insert(0, key, batch[key].to_numpy())
            yield out.astype({a: float for a in attributes})

    return rows.select(key, text).mapInPandas(run, schema)


def resumed_scores(rows: DataFrame, text: str, key: str, attributes: list[str], call: Callable, path: str, **limits) -> tuple[DataFrame, DataFrame]:
    """Scored rows (key, attributes) and dead letters (key, error, tries), from a table of attempts at `path` to which this run appends its own.

    Keys that were scored by an earlier run are not called again; those that failed are. Of rows that repeat a key one is called. A run
    is appended as a whole or not at all, so that after any number of runs, broken ones included, every key of the rows is in
    one of the results, once. limits: of call_bounded().
    """
    spark = rows.sparkSession
    attempts = spark.read.parquet(path) if exists(spark, path) else None
    todo, run = rows.dropDuplicates([key]), 1
    if attempts is not None:
        todo = todo.join(attempts.filter("error IS NULL").select(key), key, "left_anti")
        run = (attempts.agg(F.max("run")).first()[0] or 0) + 1
    call_bounded(todo, text, key, attributes, call, **limits).withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    attempts = spark.read.parquet(path)
    scored = attempts.filter("error IS NULL").select(key, *attributes)
    last = attempts.join(scored.select(key), key, "left_anti").groupBy(key).agg(F.max_by(F.struct("error", "tries"), "run").alias("x"))
    return scored, last.select(key, "x.*")
