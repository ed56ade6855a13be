"""Readers and writers with declared schemas: JSON lines, CSV scores, parquet arrays, corpus files, done sets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared shapes of the landed files.
SCHEMAS = {
    "revision": "revid long, timestamp string, user string, comment string, content string, slots struct<main:struct<content:string>>",
    "page": "mentor string, page string, len int, q_count int, wikitext string",
    "tag_revision": "mentor string, revid long, timestamp string, user string, tags array<string>",
    "conversation": "mentor string, mentee string, revid long, timestamp string, article string, question_text string, mentor_reply string, source string, page string",
    "profile": "username string, role array<string>, userid long, editcount long, registration string, groups array<string>, blocked boolean, missing boolean",
    "contribs": "username string, role string, edit_count int, edits array<struct<revid:long,parentid:long,ns:int,title:string,timestamp:string,comment:string,size:int,sizediff:int,tags:array<string>,minor:boolean,new:boolean>>",
    "annotation": "cid long, id string, Q0 string, Q2 string, Q3 string, Q4 string, Q5 string, error string",
}


def read_json(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines by a declared schema; malformed lines raise, or are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_scores(spark: SparkSession, path: str, attributes: list[str], key: str = "conversation_id") -> DataFrame:
    """CSV with a header; empty fields are null; rows without any score are left out."""
    schema = f"{key} long" + "".join(f", `{a}` double" for a in attributes)
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return rows.filter(F.coalesce(*[F.col(f"`{a}`") for a in attributes]).isNotNull())


def write(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partitions: list[str] = ()) -> None:
    out = rows.write.mode(mode)
    out = out.partitionBy(*partitions) if partitions else out
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def pruned_scan(rows: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Only rows of needed keys; a small side is broadcast by size, a large one met by shuffle or runtime filter."""
    return rows.join(needed.select(key).distinct(), key, "left_semi")


def content_of(rows: DataFrame) -> DataFrame:
    """Revisions with their content from the nested place, else the old one."""
    return rows.withColumn("content", F.coalesce("slots.main.content", "content"))


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


#: What the corpus index calls the types of fields.
INDEX_TYPES = {"string": "<class 'str'>", "bigint": "<class 'int'>", "int": "<class 'int'>", "double": "<class 'float'>", "boolean": "<class 'bool'>", "array": "<class 'list'>"}


def export_corpus(folder: str, meta: dict | None = None, **frames: DataFrame) -> None:
    """Each frame as JSON lines in a folder of its own name; corpus has the metadata, index the names and types of all fields.

    The index follows from the frames' schemas: a line has index ("utterances-index" for the frame utterances, "overall-index" for the
    metadata), field and type.
    """
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")
    spark = next(iter(frames.values())).sparkSession
    overall = spark.createDataFrame([tuple((meta or {"version": "1"}).values())], list(meta or {"version": "1"}))
    overall.coalesce(1).write.mode("overwrite").json(f"{folder}/corpus")
    fields = [(f"{name}-index", c, INDEX_TYPES.get(k.split("<")[0], k)) for name, frame in {**frames, "overall": overall}.items() for c, k in frame.dtypes]
    spark.createDataFrame(fields, "index string, field string, type string").coalesce(1).write.mode("overwrite").json(f"{folder}/index")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Used only on a local master whose session names no shared folder, as on one machine.
FALLBACK_CHECKPOINTS = "file:///tmp/checkpoints/threadloom"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or FALLBACK_CHECKPOINTS


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system client delete a path that exists when its JVM ends, whether or not the session was stopped before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/threadloom-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    delete_at_exit(spark, folder)
    return f"{folder}/data"


def cut(rows: DataFrame) -> DataFrame:
    """rows without their lineage, as a table in the shared folder that goes when the driver ends: for loops that build on their own results.

    A table's statistics are its size. (Those of a checkpoint are carried on from the plan, and grow beyond all bounds in loops of joins.)
    The table takes the place of the shuffle files that led to it: they go when it is written.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "cut")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)
