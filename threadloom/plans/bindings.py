"""How the operators' concepts map to the driver's tables; each frame has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalar import DAY, HOUR, micros

NS = {"view": 0, "click": 2, "purchase": 3, "signup": 4, "error": 118}
ASKED_FROM = 1_705_017_600_000_000  # 2024-01-12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a user's edits: us, ns, sizediff, tags, title."""
    ns = F.create_map(*[x for k, v in NS.items() for x in (F.lit(k), F.lit(v))])
    kind = F.col("event_type")
    tags = F.when(kind == "error", F.array(F.lit("mw-reverted"))).when(kind == "click", F.array(F.lit("visualeditor"), F.lit("mobile edit"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", micros(F.col("ts")).alias("us"), ns[kind].alias("ns"), (F.col("value") - 50).alias("sizediff"), tags.alias("tags"), F.get_json_object("props", "$.k").alias("title")
    )


EDITS = """edits AS (
  SELECT user_id, event_id, epoch_us(ts) AS us,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 118 END AS ns,
         value - 50 AS sizediff, json_extract_string(props, '$.k') AS title, event_type = 'error' AS bad, event_type FROM events)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's question: the first signup from 2024-01-12 on (user_id, q)."""
    e = edits(spark, sf_dir)
    return e.filter((F.col("ns") == 4) & (F.col("us") >= ASKED_FROM)).groupBy("user_id").agg(F.min("us").alias("q"))


ASKED = f"asked AS (SELECT user_id, min(us) AS q FROM edits WHERE event_type = 'signup' AND us >= {ASKED_FROM} GROUP BY user_id)"


def long_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a long history: user_id, us, ns, sizediff, tags, title; the first order from 1997 on is the question."""
    ns = F.create_map(*[x for k, v in (("1-URGENT", 0), ("2-HIGH", 2), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 0), ("5-LOW", 118)) for x in (F.lit(k), F.lit(v))])
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"), (micros(F.col("o_orderdate")) + (F.col("o_orderkey") % 24) * HOUR).alias("us"),
        F.coalesce(ns[F.col("o_orderpriority")], F.lit(4)).alias("ns"), (F.col("o_totalprice") - 250_000).alias("sizediff"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("mw-reverted"))).otherwise(F.expr("CAST(array() AS array<string>)")).alias("tags"),
        (F.col("o_orderkey") % 50).cast("string").alias("title"),
    )


LONG = """edits AS (
  SELECT o_custkey AS user_id, o_orderkey AS event_id, epoch_us(o_orderdate) + (o_orderkey % 24) * 3600000000 AS us,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 0 WHEN '5-LOW' THEN 118 ELSE 4 END AS ns,
         o_totalprice - 250000 AS sizediff, o_orderstatus = 'P' AS bad, (o_orderkey % 50)::VARCHAR AS title FROM orders)"""
LONG_FROM = 852_076_800_000_000  # 1997-01-01


def long_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_edits(spark, sf_dir).filter(F.col("us") >= LONG_FROM).groupBy("user_id").agg(F.min("us").alias("q"))


LONG_ASKED = f"asked AS (SELECT user_id, min(us) AS q FROM edits WHERE us >= {LONG_FROM} GROUP BY user_id)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: conv_id, first user turn, first later assistant turn."""
    t = table(spark, sf_dir, "conversations")
    first = t.filter("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("u"))
    reply = t.filter("role = 'assistant'").join(first, "conv_id").filter(F.col("turn") > F.col("u.turn")).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("a"))
    return first.join(reply, "conv_id", "left").select("conv_id", F.col("u.text").alias("question"), F.col("a.text").alias("reply"))


TURNS = """first_user AS (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
first_reply AS (SELECT c.conv_id, min(c.turn) AS t FROM conversations c JOIN first_user u ON u.conv_id = c.conv_id WHERE c.role = 'assistant' AND c.turn > u.t GROUP BY c.conv_id),
turns AS (SELECT u.conv_id, c.text AS question, r.text AS reply FROM first_user u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.t
  LEFT JOIN first_reply f ON f.conv_id = u.conv_id LEFT JOIN conversations r ON r.conv_id = f.conv_id AND r.turn = f.t)"""


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as units of a stratified comparison: id, cluster, d, y, y2, ps and covariates."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("cluster"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("d"),
        (F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("y2"),
        F.round(0.2 + 0.5 * F.col("l_discount") * 10 / 2 + F.col("l_tax"), 6).alias("ps"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


SAMPLE = """sample AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS cluster, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS d,
         (l_returnflag = 'R')::INT::DOUBLE AS y, (l_quantity > 25)::INT::DOUBLE AS y2, round(0.2 + 0.5 * l_discount * 10 / 2 + l_tax, 6) AS ps,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
__all__ = [n for n in dir() if not n.startswith("_")] + ["DAY"]
