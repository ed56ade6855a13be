"""What the operators of this subpackage share: tables cut out of the lineage, code for executors."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.io import delete_at_exit

#: Used only on a local master whose session names no shared folder, as in tests on one machine.
FALLBACK_DIR = "file:///tmp/checkpoints/threadloom"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Words are maximal runs of characters other than space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or FALLBACK_DIR


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the tasks it ran since, and a join on the
    returned table has a plain exchange on that side, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the table takes the place of the shuffle files that led to it
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of saved() that nothing reads any more; those still left go when the driver's JVM ends."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.saved_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that columns have, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Arrow batches of texts, whose rows can be long, are cut by size too, so that executors hold little of them at once.
BATCH_BYTES = 4 << 20

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not share the driver's import path, and bound Arrow batches.

    Only sources travel; each worker holds one copy. Called again for the same application it sends nothing. A limit for
    batches that the application was started with stays.
    """
    if not spark.sparkContext.getConf().contains(_BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "threadloom_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "threadloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    before = list(sys.path)
    spark.sparkContext.addPyFile(path)
    sys.path[:] = before
    _shipped[app] = path


def one_thread() -> None:
    """Keep the tokenizers library of this process to one thread, unless the environment says otherwise.

    A task has one core; the library would start a thread for each of the machine's, which costs CPU time and memory.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
