"""Tables, checkpoints and scratch folders go when the driver ends, also after spark.stop()."""

import os
import subprocess
import sys
import time

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from threadloom.sources import io
a, b = io.cut(spark.range(10)), io.cut(spark.range(5))
spark.range(3).write.parquet(io.scratch(spark, "sink"))
assert a.count() + b.count() == 15
import os
print("HELD", sum(len(f) for _, _, f in os.walk(sys.argv[1][7:])), flush=True)
if sys.argv[2] == "stop":
    spark.stop()
"""


def left_behind(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]


def test_nothing_is_left_after_a_driver(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for how in ("stop", "end"):
        folder = tmp_path / how
        folder.mkdir()
        run = subprocess.run([sys.executable, "-c", SCRIPT, f"file://{folder}", how], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]
        assert int(run.stdout.split("HELD")[1]) > 5
        for _ in range(60):
            if not left_behind(folder):
                break
            time.sleep(0.5)
        assert left_behind(folder) == []
