"""Exact deduplication: skew-safe combining of digests with full content compared at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import documents, quoted, saved, text_or_empty

#: Into how many parts the rows of one digest are dealt before they are combined.
SALTS = 16


def winners(docs: DataFrame, salts: int = SALTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per distinct text: digest, content, keep_id (the largest id), group_size.

    Three combining steps: each task combines its own rows (Spark's partial aggregation), then the rows of each
    (digest, salt), then the salts' winners of each digest. All three group by the digest and the whole text, so rows
    count as equal only after their full contents compared equal; a digest collision gives two rows. No step
    sees more than one row per earlier task or salt for a text, however many copies it has.
    """
    rows = docs.select(
        F.sha2(text_or_empty(text_column), 256).alias("digest"),
        text_or_empty(text_column).alias("content"),
        F.pmod(F.xxhash64(F.col(id_column)), F.lit(salts)).alias("salt"),
        F.col(id_column).alias("id"),
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, keep_id (the largest id with an equal text), group_size, kept, text_sha256.

    Null text counts as empty. Rows that repeat an id with the same text are each returned and count in
    group_size; all rows of the winning id have kept = true. A null id loses to any other and is kept only if
    all of its group's ids are null. An empty table gives an empty result; other columns are ignored.
    """
    best = winners(docs, salts, id_column, text_column)
    # The digest settles a row's group unless two different texts share it, which the full comparison shows.
    best = saved(
        best.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count("*").alias("n_texts"),
        ),
        "digests",
    )
    rows = docs.select(F.col(id_column), F.sha2(text_or_empty(text_column), 256).alias("digest"))
    out = rows.join(best.filter("n_texts = 1"), "digest")
    if not best.filter("n_texts > 1").isEmpty():
        torn = best.filter("n_texts > 1").select("digest")
        split = winners(docs.join(torn, F.sha2(text_or_empty(text_column), 256) == torn.digest, "left_semi"), salts, id_column, text_column)
        again = docs.select(F.col(id_column), F.sha2(text_or_empty(text_column), 256).alias("digest"), text_or_empty(text_column).alias("content"))
        out = out.select(id_column, "digest", "keep_id", "group_size").union(
            again.join(split, ["digest", "content"]).select(id_column, "digest", "keep_id", "group_size")
        )
    return out.select(
        F.col(id_column),
        F.col("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col(id_column).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs without the rows whose text a row with a larger doc_id has too; columns unchanged, whatever their names.

    The surviving row itself travels as the aggregate's value, so that no join is needed: rows are grouped by digest
    and text as in winners(). Null text counts as empty, and a row that stays keeps its null; a null doc_id loses to any other;
    of rows with equal id and text one stays, chosen by a hash of
    the other columns; an empty table stays empty.
    """
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    values = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns) if not _unordered(docs.schema[c].dataType)]
    others = F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns)])
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("key"), F.xxhash64(F.col("doc_id"), *values).alias("tie"))
    rows = docs.select(
        F.sha2(text_or_empty(), 256).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
        text_or_empty().alias("content"),
        F.struct(order.alias("order"), F.col("doc_id").alias("id"), F.col("text").isNull().alias("no_text"), others.alias("others")).alias("row"),
    )
    best = rows.groupBy("digest", "salt", "content").agg(F.max_by("row", "row.order").alias("row"))
    best = best.groupBy("digest", "content").agg(F.max_by("row", "row.order").alias("row"))
    place = {c: k for k, c in enumerate(columns)}
    own = {"doc_id": F.col("row.id"), "text": F.when(~F.col("row.no_text"), F.col("content"))}
    return best.select(*[(own[c] if c in own else F.col(f"row.others.c{place[c]}")).alias(c) for c in docs.columns])


def _unordered(kind) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
