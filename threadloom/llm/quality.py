"""Quality rules whose cutoffs are chosen on labelled documents so that false rejections stay within a proven limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import WORD_GAP, documents, quoted, saved, text_or_empty

#: Good documents of a stratum that may be rejected in all, as a share, and the chance that this fails anywhere.
ALPHA, DELTA = 0.03, 0.05
#: Tables of thresholds up to so many strata are broadcast.
BROADCAST_STRATA = 10_000
#: name -> (SQL of the measure, levels a unit). Levels are whole numbers without a bound; a document is rejected above the cutoff.
MEASURES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 100),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 200),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 200),
    "long_words": ("word_chars / greatest(n_words, 1)", 20),
    "short_words": ("greatest(0, 10 - word_chars / greatest(n_words, 1))", 20),
}

FEATURES = ("word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_repeat_words", "text_digest")

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def text_features(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) and text_digest (binary) instead of the text.

    Columns of docs with these names are replaced, all others kept, whatever their names.

    All are computed within a row, so nothing is shuffled and a copied or common line makes no group. Null and empty
    texts have zeros. n_repeat_words counts words in 3-word windows that occur twice or more in their text: the
    windows' hashes are sorted with their positions, and the union of the repeated windows' spans is summed.
    """
    text = text_or_empty(text_column)
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator is not merged into later expressions, so c is computed once
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    kept = [c for c in docs.columns if c != text_column and c.lower() not in FEATURES]
    out = docs.select(
        *[F.col(quoted(c)).alias(f"__column{k}") for k, c in enumerate(kept)],
        F.unhex(F.md5(text)).alias("text_digest"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        once(F.struct(words.alias("w"), lines.alias("l"))).alias("__t"),
    )
    out = out.select(
        *[c for c in out.columns if c != "__t"],
        F.size("__t.w").cast("long").alias("n_words"),
        F.size("__t.l").cast("long").alias("n_lines"),
        (F.size("__t.l") - F.size(F.array_distinct("__t.l"))).cast("long").alias("n_dup_lines"),
        once(
            F.expr(
                "CASE WHEN size(__t.w) < 3 THEN CAST(array() AS array<bigint>) ELSE "
                "zip_with(zip_with(__t.w, slice(__t.w, 2, size(__t.w) - 2), (a, b) -> xxhash64(a, b)), "
                "slice(__t.w, 3, size(__t.w) - 2), (h, c) -> CASE WHEN c IS NULL THEN NULL ELSE xxhash64(h, c) END) END"
            )
        ).alias("__g"),
    )
    keep = [c for c in out.columns if c != "__g"]
    repeated = F.expr(
        "CASE WHEN size(array_distinct(__g)) = size(__g) THEN CAST(array() AS array<struct<h:bigint,i:int>>) "
        "ELSE sort_array(filter(transform(__g, (h, i) -> named_struct('h', h, 'i', i)), x -> x.h IS NOT NULL)) END"
    )
    out = out.select(*keep, once(repeated).alias("__s"))
    spans = F.expr(
        "CASE WHEN size(__s) = 0 THEN CAST(array() AS array<int>) ELSE sort_array(transform(filter("
        "zip_with(zip_with(__s, slice(concat(array(CAST(NULL AS struct<h:bigint,i:int>)), __s), 1, size(__s)), "
        "(x, p) -> named_struct('i', x.i, 'h', x.h, 'd', coalesce(x.h = p.h, false))), "
        "slice(__s, 2, size(__s)), (x, q) -> named_struct('i', x.i, 'd', x.d OR coalesce(x.h = q.h, false))), "
        "x -> x.d), x -> x.i)) END"
    )
    out = out.select(*keep, once(spans).alias("__p"))
    covered = F.expr(
        "aggregate(__p, named_struct('n', 0L, 'e', 0), (a, x) -> named_struct('n', a.n + (x + 3 - greatest(x, a.e)), 'e', x + 3), a -> a.n)"
    )
    own = {f"__column{k}": c for k, c in enumerate(kept)}
    return out.select(*[F.col(c).alias(own.get(c, c)) for c in keep], covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _level(name: str) -> Column:
    sql, scale = MEASURES[name]
    return F.floor(F.expr(sql) * scale).cast("long")


def binomial_tail_sql(k: str, n: str, p: float) -> str:
    """SQL of P(X <= k) for X ~ Bin(n, p), exactly, by summing logarithms; 1 where k > n * p, where it decides nothing."""
    p = f"CAST({p!r} AS double)"  # a bare literal would be a decimal
    t = f"(a.t + ln(({n} - i + 1) / i) + ln({p} / (1 - {p})))"
    first = f"({n} * ln(1 - {p}))"
    return (
        f"CASE WHEN {k} > {n} * {p} THEN 1D ELSE aggregate("
        f"CASE WHEN {k} < 1 THEN CAST(array() AS array<bigint>) ELSE sequence(1L, {k}) END, "
        f"named_struct('t', CAST({first} AS double), 's', CAST({first} AS double)), "
        f"(a, i) -> named_struct('t', {t}, 's', greatest(a.s, {t}) + ln(1 + exp(-abs(a.s - {t})))), a -> exp(a.s)) END"
    )


def select_cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: a level for each measure above which documents are rejected, or null for none.

    On the labelled rows (quality 1: good, 0: bad) that pass the base rules, a cutoff that rejects k of n good
    documents is admitted if P(Bin(n, alpha / measures) <= k) <= delta / (strata * measures): the exact upper bound
    of its false-rejection rate is then at most alpha / measures. A cutoff is admitted only if all looser ones are (k
    grows as cutoffs fall), so that each sequence is tested in a fixed order and needs no correction in itself; over
    strata and measures Bonferroni's correction holds, for all at once with probability 1 - delta. Of the admitted cutoffs the one with the
    largest surplus of bad over good rejections is chosen, the loosest on ties, none without a surplus. Strata too small to
    prove anything get none.

    A text counts once in a stratum, however many copies and label rows it has, as a bound for independent trials asks: as good if
    any of its labels says so. (Near copies still count each.) Null labels are ignored; null strata form one stratum.
    """
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality"))
    seen = features.filter(~base_failed()).join(known, F.col("doc_id") == F.col("__id"))
    texts = seen.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), "text_digest").agg(F.max("__quality").alias("quality"), *[F.max(_level(m)).alias(m) for m in MEASURES])
    counts = (
        texts.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("level")) for m in MEASURES])).alias("m"))
        .groupBy("stratum", "m.measure", "m.level")
        .agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    )
    # What rejects from a level on; between two levels that occur the loosest cutoff stands. A row for each level that occurs.
    of_measure = W.partitionBy("stratum", "measure")
    from_here = of_measure.orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, 0)
    grid = counts.select("stratum", "measure", (F.col("level") - 1).alias("cut"), F.sum("good").over(of_measure).alias("n"), F.sum("good").over(from_here).alias("k"), F.sum("bad").over(from_here).alias("hit"))
    strata = counts.select("stratum").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("n_strata"))
    admitted = grid.filter("hit > k AND n > 0").withColumn("tail", F.expr(binomial_tail_sql("k", "n", alpha / len(MEASURES))))
    admitted = admitted.join(F.broadcast(strata), F.col("tail") * F.col("n_strata") <= F.lit(delta / len(MEASURES)))  # one row
    best = admitted.groupBy("stratum", "measure").agg(F.max_by("cut", F.struct(F.col("hit") - F.col("k"), "cut")).alias("cut"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("measure") == m, F.col("cut"))).alias(f"cut_{m}") for m in MEASURES])


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false if base_failed, and otherwise unless a measure lies above its stratum's cutoff. Null texts count
    as empty and fail the base rules; repeated rows are each judged; without labels only the base rules reject.
    Columns of docs other than doc_id, text and the stratum's are ignored.
    """
    features = saved(text_features(docs.select("doc_id", F.col(stratum).alias("of_stratum"), "text")), "quality-features")
    cuts = saved(select_cutoffs(features, labels, "of_stratum", alpha, delta), "quality-cutoffs")
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    judged = features.join(cuts, F.coalesce(F.col("of_stratum"), F.lit("")) == F.col("stratum"), "left")
    fine = F.lit(True)
    for m in MEASURES:
        fine = fine & F.coalesce(_level(m) <= F.col(f"cut_{m}"), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP1_SQL = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
f0 AS (
  SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS l,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM f0),
tri AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS d FROM tri WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) v(k) WHERE d GROUP BY doc_id),
f AS (
  SELECT f0.doc_id, lang, text, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(l) AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM f0 LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
m AS (SELECT doc_id, coalesce(lang, '') AS stratum, text, base_failed, unnest([{', '.join(f"{{'m': '{m}', 'v': floor(({sql}) * {scale})::BIGINT}}" for m, (sql, scale) in MEASURES.items())}]) AS x FROM g),
s AS (SELECT stratum, text, x.m AS m, any_value(x.v) AS v, max(quality) AS quality FROM m JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY stratum, text, x.m),
level AS (SELECT stratum, m, v, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM s GROUP BY ALL),
cuts AS (SELECT stratum, m, v - 1 AS cut, (sum(good) OVER (PARTITION BY stratum, m))::BIGINT AS n, (sum(good) OVER o)::BIGINT AS k, (sum(bad) OVER o)::BIGINT AS hit
  FROM level WINDOW o AS (PARTITION BY stratum, m ORDER BY v DESC)),
ok AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({ALPHA / len(MEASURES)}) + (n - i) * ln(1 - {ALPHA / len(MEASURES)})))) AS tail FROM cuts WHERE hit > k AND n > 0 AND k <= n * {ALPHA / len(MEASURES)}),
best AS (SELECT stratum, m, max_by(cut, (hit - k)::HUGEINT * 1000000000 + cut) AS cut FROM ok
  WHERE tail * (SELECT count(DISTINCT stratum) FROM s) <= {DELTA / len(MEASURES)} GROUP BY stratum, m),
bad AS (SELECT DISTINCT doc_id FROM m JOIN best ON best.stratum = m.stratum AND best.m = m.x.m AND m.x.v > best.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM g
"""
