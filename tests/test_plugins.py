"""Calls of services: bounded concurrency, tries and waits, dead letters, resumption."""

import asyncio
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import plugins as P


def texts(spark, n):
    return spark.createDataFrame([(i, f"t{i}" if i % 7 else None) for i in range(n)], "id long, text string").repartition(2)


@pytest.mark.parametrize("kind", ["thread", "coroutine"])
def test_calls_are_bounded_and_tried_again(spark, tmp_path, kind):
    log = str(tmp_path)

    def noted(text):
        with open(f"{log}/{threading.get_native_id()}-{time.time_ns()}", "w") as f:
            json.dump([text, time.time()], f)

    def service(text):
        noted(text)
        time.sleep(0.02)
        if text.endswith("3"):
            raise OSError("down")
        return {"n": len(text), "none": None}

    async def slow(text):
        noted(text)
        await asyncio.sleep(0.02)
        if text.endswith("3"):
            raise OSError("down")
        return {"n": len(text), "none": None}

    out = P.call_bounded(texts(spark, 60), "text", "id", ["n", "none"], service if kind == "thread" else slow, concurrency=3, tries=3, waits=(0.01,)).collect()
    assert sorted(r.id for r in out) == list(range(60))
    for r in out:
        text = f"t{r.id}" if r.id % 7 else ""
        bad = text.endswith("3")
        assert (r.error, r.tries) == (("down", 3) if bad else (None, 1)) and (r.n is None or r.n != r.n if bad else r.n == len(text))
    calls = sum(1 for _ in tmp_path.iterdir())
    assert calls == 60 + 2 * sum(1 for i in range(60) if i % 7 and i % 10 == 3)


def test_calls_that_take_too_long_are_dead(spark):
    async def hangs(text):
        await asyncio.sleep(5)

    out = P.call_bounded(texts(spark, 3), "text", "id", ["n"], hangs, tries=1, most_seconds=0.05).collect()
    assert {r.error for r in out} == {"TimeoutError"}


def test_no_row_is_lost_or_twice(spark, tmp_path):
    rows, path, marks = texts(spark, 40).union(texts(spark, 5)), f"file://{tmp_path}/attempts", tmp_path / "calls"
    marks.mkdir()
    place = str(marks)

    def service(text):
        open(f"{place}/{text}-{time.time_ns()}", "w").close()
        n = len([f for f in __import__("os").listdir(place) if f.split("-")[0] == text])
        if text.endswith("1") or (text.endswith("2") and n < 2):  # some never answer, some the second time
            raise ValueError(f"no {text}")
        return {"n": len(text)}

    scored, dead = P.resumed_scores(rows, "text", "id", ["n"], service, path, tries=1)
    first = {r.id for r in scored.collect()}
    assert len(first) + dead.count() == 40
    scored, dead = P.resumed_scores(rows, "text", "id", ["n"], service, path, tries=1)
    got, lost = [r.id for r in scored.collect()], {r.id: r.error for r in dead.collect()}
    assert sorted(got + list(lost)) == list(range(40)) and first < set(got)
    assert set(lost) == {i for i in range(40) if i % 7 and i % 10 == 1} and lost[11] == "no t11"
    called = [f.name.split("-")[0] for f in marks.iterdir()]
    assert all(called.count(f"t{i}") == 1 for i in first if i % 7)


def test_prompts(spark):
    made = P.annotation_prompt(F.col("text"), "Book", [("Hi", {"Q0": "Y"})])
    r = spark.createDataFrame([("Why?",), (None,)], "text string").select(*[c.alias(k) for k, c in made.items()]).collect()
    assert r[0].system == 'Book\n\n---\n\n## Examples\n\nMessage: Hi\nAnswer: {"Q0": "Y"}' and r[0].user == "Message: Why?\nAnswer:" and r[1].user == "Message: \nAnswer:"
