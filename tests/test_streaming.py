"""Streams against their batch forms, and plug-in scorers."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from threadloom.functions import plugins
from threadloom.operators.sequence import snapshot_events
from threadloom.streaming import roster


def drained(spark, frame, mode, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def landed(spark, rows, schema, tmp_path, files=3):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_each_key_once(spark, tmp_path):
    stream = landed(spark, [(k % 4, f"2024-01-01 00:00:0{k % 4}") for k in range(12)], "id int, ts string", tmp_path)
    out = drained(spark, roster.ingest(stream.withColumn("ts", F.col("ts").cast("timestamp")), "id", "ts"), "append", tmp_path)
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 3]


def test_roster_equals_snapshot_difference(spark, tmp_path):
    rows = [(m, s, (m * 7 + s * s) % 3 > 0) for s in range(6) for m in range(5)]
    stream = landed(spark, rows, "member int, seq long, present boolean", tmp_path, files=1)
    got = sorted((r.seq, r.member, r.event) for r in drained(spark, roster.roster_states(stream), "append", tmp_path).collect())
    members = spark.createDataFrame([(s, m) for m, s, p in rows if p], "seq long, member int")
    snaps = spark.createDataFrame([(s, s) for s in range(6)], "seq long, us long")
    assert got == sorted((r.seq, r.member, r.event) for r in snapshot_events(members, snaps).collect())


def test_append_is_resumed(spark, tmp_path):
    stream = landed(spark, [(k,) for k in range(9)], "id int", tmp_path)
    for _ in range(2):
        roster.append_with_checkpoint(stream, str(tmp_path / "out"), str(tmp_path / "done")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_scorers(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "a"), (3, None), (4, "boom")], "id long, text string")

    def length(texts):
        return pd.DataFrame({"n": texts.str.len().astype(float)})

    def broken(texts):
        raise RuntimeError("service is down")

    assert {r.id: r.n for r in plugins.score_with(rows, "text", "id", ["n"], length).fillna(-1.0).collect()} == {1: 3.0, 2: -1.0, 3: -1.0, 4: 4.0}
    assert {r.error for r in plugins.score_with(rows, "text", "id", ["n"], broken).collect()} == {"service is down", None}

    def one_fails(texts):
        if (texts == "boom").any():
            raise RuntimeError("bad text")
        return length(texts)

    out = {r.id: (r.n, r.error) for r in plugins.score_with(rows, "text", "id", ["n"], one_fails).fillna(-1.0).collect()}
    assert out == {1: (3.0, None), 2: (-1.0, None), 3: (-1.0, None), 4: (-1.0, "bad text")}
    assert plugins.score_with(spark.createDataFrame([(1, "x" * 20_000)], "id long, text string"), "text", "id", ["n"], length).first().n == 20_000
    scores = spark.createDataFrame([(1, 0.5)], "id long, s double")
    assert {r.id: r.s for r in plugins.table_scores(rows, scores, "id", ["s"]).collect()} == {1: 0.5, 2: None, 3: None, 4: None}
    assert plugins.zero_scores(rows, ["v"]).first().v == 0
