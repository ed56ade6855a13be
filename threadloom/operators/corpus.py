"""Corpus export: cleaned conversations as utterances, speakers, conversations and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_SECONDS = 300


def clean_conversations(rows: DataFrame) -> DataFrame:
    """Rows with a mentee and a question; a reply that comes over five minutes before its question, or is empty, is none.

    Columns: mentee, question, reply, asked_us, replied_us, has_reply. Unknown times are ignored.
    """
    early = F.coalesce(F.col("replied_us") < F.col("asked_us") - TOLERANCE_SECONDS * 1_000_000, F.lit(False))
    keep = F.col("has_reply") & ~early & (F.trim(F.coalesce("reply", F.lit(""))) != "")
    out = rows.filter((F.coalesce("mentee", F.lit("")) != "") & (F.trim(F.coalesce("question", F.lit(""))) != ""))
    return out.withColumns({"has_reply": keep, "reply": F.when(keep, F.col("reply")), "replied_us": F.when(keep, F.col("replied_us"))})


def reply_speaker(signer: Column, responders: Column, mentor: Column) -> Column:
    """The first responder who is not the mentor if only others signed, else the mentor."""
    return F.when(signer == "other_only", F.coalesce(F.get(F.filter(responders, lambda x: x != mentor), 0), mentor)).otherwise(mentor)


def utterances(rows: DataFrame) -> DataFrame:
    """A question and, where there is one, a reply per conversation; ids q_<n> and r_<n>."""
    q = F.struct(F.concat(F.lit("q_"), "id").alias("utterance"), F.col("mentee").alias("speaker"), F.lit(None).cast("string").alias("reply_to"), F.col("asked_us").alias("us"), F.col("question").alias("text"))
    r = F.struct(F.concat(F.lit("r_"), "id").alias("utterance"), F.col("speaker").alias("speaker"), F.concat(F.lit("q_"), "id").alias("reply_to"), F.col("replied_us").alias("us"), F.col("reply").alias("text"))
    both = F.array_compact(F.array(q, F.when(F.col("has_reply"), r)))
    return rows.select(F.concat(F.lit("q_"), "id").alias("conversation"), F.explode(both).alias("u")).select("conversation", "u.*")


def speakers(rows: DataFrame) -> DataFrame:
    """Each name with the role it first appears in, in the order mentee, mentor, other responder of each conversation."""
    seen = F.array_compact(
        F.array(
            F.struct(F.col("mentee").alias("speaker"), F.lit(0).alias("k"), F.lit("mentee").alias("role")),
            F.struct(F.col("mentor").alias("speaker"), F.lit(1).alias("k"), F.lit("mentor").alias("role")),
            F.when(F.col("has_reply") & (F.col("speaker") != F.col("mentor")), F.struct(F.col("speaker"), F.lit(2).alias("k"), F.lit("other_responder").alias("role"))),
        )
    )
    long = rows.select("id", F.explode(seen).alias("s")).select("id", "s.*").filter("speaker IS NOT NULL")
    return long.groupBy("speaker").agg(F.min_by("role", F.struct("id", "k")).alias("role"))


def totals(utterance_rows: DataFrame, speaker_rows: DataFrame) -> DataFrame:
    """Conversations, utterances, replies, and speakers by role, as one row."""
    u = utterance_rows.agg(F.count_distinct("conversation").alias("conversations"), F.count("*").alias("utterances"), F.count("reply_to").alias("replies"))
    s = speaker_rows.agg(F.count("*").alias("speakers"), *[F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("mentee", "mentor", "other_responder")])
    return u.crossJoin(s)  # one row each
