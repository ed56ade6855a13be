"""Queries of scans, filters, joins, set operations, sorts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import cluster as C
from threadloom.operators import corpus as K
from threadloom.operators import sequence as seq
from threadloom.operators import stats as St
from threadloom.plans import bindings as B
from threadloom.plans.registry import query
from threadloom.sources import io

t = B.table


# -- scans --------------------------------------------------------------------------------------------------------------------


@query("a04_listing_by_name", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'page=') OR url LIKE 'https://m.%'")
def a04(spark, sf):
    return t(spark, sf, "pages").filter(F.lower("url").contains("page=") | F.col("url").startswith("https://m.")).select("page_id", "url")


@query("a06_tagged_revisions", "SELECT DISTINCT event_id, user_id FROM events WHERE event_type IN ('error', 'click')")
def a06(spark, sf):
    e = B.edits(spark, sf)
    wanted = F.array(F.lit("mw-reverted"), F.lit("mobile edit"))
    return e.filter(F.arrays_overlap("tags", wanted)).dropDuplicates(["event_id"]).select("event_id", "user_id")


@query("a08_profiles_with_defaults", "SELECT c_custkey, coalesce(n, 0) AS edit_count, coalesce(last, 'never') AS last FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, max(event_type) AS last FROM events GROUP BY 1) ON user_id = c_custkey")
def a08(spark, sf):
    e = t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("edit_count"), F.max("event_type").alias("last"))
    return io.with_defaults(t(spark, sf, "customer").select("c_custkey").join(e, F.col("c_custkey") == F.col("user_id"), "left").drop("user_id"), {"edit_count": 0, "last": "never"})


@query("a09_contributions_since", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def a09(spark, sf):
    return t(spark, sf, "events").filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "user_id")


@query("a10_log_flags", "SELECT user_id, count(*) AS event_count, bool_or(event_type = 'error') AS has_block, bool_or(event_type = 'signup') AS has_rights_change FROM events WHERE event_type IN ('error', 'signup', 'view') GROUP BY 1")
def a10(spark, sf):
    e = t(spark, sf, "events").filter(F.col("event_type").isin("error", "signup", "view"))
    return e.groupBy("user_id").agg(F.count("*").alias("event_count"), F.bool_or(F.col("event_type") == "error").alias("has_block"), F.bool_or(F.col("event_type") == "signup").alias("has_rights_change"))


@query("a11_abuse_totals", "SELECT user_id, count(*) AS abuse_count FROM events WHERE event_type = 'error' GROUP BY 1")
def a11(spark, sf):
    return t(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("abuse_count"))


@query("a14_a16_json_lines", "SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 10 <> 0")
def a14(spark, sf):
    """Lines written as a file, every tenth of them broken, and read by the tolerant reader."""
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "user_id", F.from_json("props", "k long").alias("props"))))
    t(spark, sf, "events").select(line.alias("value")).write.text(path := io.scratch(spark, "lines"))
    rows = io.read_json(spark, path, "event_id long, user_id long, props struct<k: long>", tolerant=True)
    return rows.select("event_id", "user_id", F.col("props.k").alias("k"))


@query("a15_semi_join_scan", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def a15(spark, sf):
    needed = t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return io.pruned_scan(t(spark, sf, "events").select("event_id", "user_id"), needed, "user_id").select("event_id")


@query("a17_csv_scores", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS score FROM lineitem WHERE l_discount > 0 OR l_tax > 0.01")
def a17(spark, sf):
    """Scores written as CSV with a header and empty fields, and read again; rows without any score are left out."""
    l = t(spark, sf, "lineitem")
    rows = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("b"))
    io.write(rows, path := io.scratch(spark, "scores"), "csv")
    read = io.read_scores(spark, path, ["a", "b"], "line")
    return read.select(F.floor(F.col("line") / 10).alias("l_orderkey"), (F.col("line") % 10).alias("l_linenumber"), F.col("a").alias("score"))


@query("a19_named_arrays", "SELECT vec_id, label, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def a19(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query("a21_histogram_data", "SELECT least(greatest(floor((o_totalprice - 0) / 25000), 0), 20)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def a21(spark, sf):
    b = F.least(F.greatest(F.floor(F.col("o_totalprice") / 25000), F.lit(0)), F.lit(20))
    return t(spark, sf, "orders").groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("a23_d03_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a23(spark, sf):
    return seq.todo(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")


@query("a24_h02_done_set", "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'de'")
def a24(spark, sf):
    return t(spark, sf, "labels").select("doc_id").union(t(spark, sf, "documents").filter("lang = 'de'").select("doc_id")).distinct()


@query("a25_last_valid", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def a25(spark, sf):
    return seq.last_valid(t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") != "error")


@query("a26_override", "SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT user_id, count(*) AS v FROM events WHERE event_type = 'view' GROUP BY 1) o FULL JOIN (SELECT user_id, -count(*) AS v FROM events WHERE value > 200 GROUP BY 1) n USING (user_id)")
def a26(spark, sf):
    e = t(spark, sf, "events")
    old = e.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("v"))
    new = e.filter("value > 200").groupBy("user_id").agg((-F.count("*")).alias("v"))
    return seq.override(old, new, "user_id")


# -- filters ------------------------------------------------------------------------------------------------------------------


@query("c01_sample_restriction", "SELECT doc_id FROM documents WHERE lang = 'en' AND length(text) > 100 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def c01(spark, sf):
    d = t(spark, sf, "documents").filter((F.col("lang") == "en") & (F.length("text") > 100))
    return seq.first_per_key(d.select("doc_id", "source"), ["source"], F.col("doc_id")).select("doc_id")


@query("c02_corpus_filter", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def c02(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("c03_row_limit", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def c03(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(25)


def _conversations(spark, sf):
    e = B.edits(spark, sf)
    return e.select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 20 > 0, F.concat(F.lit("u"), "user_id")).alias("mentee"), F.concat(F.lit("m"), F.col("user_id") % 7).alias("mentor"),
        F.when(F.col("ns") != 0, F.concat(F.lit("q"), "title")).otherwise(" ").alias("question"), F.when(F.col("ns") != 2, F.concat(F.lit("r"), "title")).otherwise("").alias("reply"),
        F.col("us").alias("asked_us"), (F.col("us") + ((F.col("event_id") % 13) - 6) * 100_000_000).alias("replied_us"), (F.col("event_id") % 5 > 0).alias("has_reply"),
        F.when(F.col("event_id") % 11 == 0, "other_only").otherwise("assigned_mentor").alias("signer"), F.array(F.concat(F.lit("m"), F.col("user_id") % 7), F.concat(F.lit("x"), F.col("event_id") % 3)).alias("responders"),
    )


_CONV = f"""{B.EDITS}, raw AS (SELECT event_id AS id, CASE WHEN user_id % 20 > 0 THEN 'u' || user_id END AS mentee, 'm' || user_id % 7 AS mentor, CASE WHEN ns <> 0 THEN 'q' || title ELSE ' ' END AS question,
 CASE WHEN ns <> 2 THEN 'r' || title ELSE '' END AS reply, us AS asked_us, us + ((event_id % 13) - 6) * 100000000 AS replied_us, event_id % 5 > 0 AS has, event_id % 11 = 0 AS other, 'x' || event_id % 3 AS x FROM edits),
 conv AS (SELECT id, mentee, mentor, question, asked_us, has AND replied_us >= asked_us - 300000000 AND trim(reply) <> '' AS has_reply, reply, replied_us, CASE WHEN other THEN x ELSE mentor END AS speaker FROM raw WHERE coalesce(mentee, '') <> '' AND trim(question) <> '')"""


def _cleaned(spark, sf):
    c = K.clean_conversations(_conversations(spark, sf))
    return c.withColumn("speaker", K.reply_speaker(F.col("signer"), F.col("responders"), F.col("mentor")))


@query("c04_corpus_cleaning", f"WITH {_CONV} SELECT id, has_reply, CASE WHEN has_reply THEN reply END AS reply, CASE WHEN has_reply THEN replied_us END AS replied_us FROM conv")
def c04(spark, sf):
    return _cleaned(spark, sf).select("id", "has_reply", "reply", "replied_us")


@query("c05_unknown_signer", f"WITH {B.EDITS} SELECT event_id, ns <> 118 AS has_reply, CASE WHEN ns <> 118 THEN title END AS reply FROM edits")
def c05(spark, sf):
    known = F.col("ns") != 118
    return B.edits(spark, sf).select("event_id", known.alias("has_reply"), F.when(known, F.col("title")).alias("reply"))


@query("c06_drop_reverted", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS kept, count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY 1")
def c06(spark, sf):
    lists = t(spark, sf, "events").select("user_id", F.explode(F.array(F.struct(F.when(F.col("event_type") == "error", True).alias("reverted")))).alias("m"))
    bad = F.coalesce("m.reverted", F.lit(False))
    return lists.groupBy("user_id").agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("skipped"))


@query("c08_overlapping_groups", "SELECT g, count(*) AS n, sum(toxic)::BIGINT AS n_toxic FROM (SELECT toxic, unnest(list_filter(['full', CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 1 AND toxic = 0 THEN 'technical' END, CASE WHEN quality = 0 THEN 'rest' END], lambda z: z IS NOT NULL)) AS g FROM labels) GROUP BY g")
def c08(spark, sf):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    groups = F.array_compact(F.array(F.lit("full"), F.when(q, "good"), F.when(x, "toxic"), F.when(q & ~x, "technical"), F.when(~q, "rest")))
    return t(spark, sf, "labels").select("toxic", F.explode(groups).alias("g")).groupBy("g").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))


@query("c09_score_trims", f"WITH {B.SAMPLE} SELECT lo, count(*) AS n, sum(d)::BIGINT AS treated FROM sample, (VALUES (0.25), (0.3), (0.35)) g(lo) WHERE ps BETWEEN lo AND 1 - lo GROUP BY lo")
def c09(spark, sf):
    s = B.sample(spark, sf).withColumn("lo", F.explode(F.array(*[F.lit(x) for x in (0.25, 0.3, 0.35)])))
    return s.filter(F.col("ps").between(F.col("lo"), 1 - F.col("lo"))).groupBy("lo").agg(F.count("*").alias("n"), F.sum("d").alias("treated")).withColumn("lo", F.col("lo").cast("decimal(3,2)"))


@query("c10_common_support", f"WITH {B.SAMPLE}, b AS (SELECT greatest(min(ps) FILTER (d = 1), min(ps) FILTER (d = 0)) AS low, least(max(ps) FILTER (d = 1), max(ps) FILTER (d = 0)) AS high FROM sample) SELECT low, high, count(*) FILTER (ps < low OR ps > high) AS outside, count(*) AS n FROM sample, b GROUP BY low, high")
def c10(spark, sf):
    return St.common_support(B.sample(spark, sf))


@query("c11_complete_cases", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def c11(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").dropna(how="any", subset=["text", "quality", "toxic"]).select("doc_id")


@query("c12_size_guards", "SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 50 AND count(*) FILTER (lang = 'en') >= 2")
def c12(spark, sf):
    g = t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("e"))
    return g.filter("n >= 50 AND e >= 2").select("source", "n")


@query("c13_c14_status", "SELECT event_id, 'ok' AS status, coalesce(CASE WHEN event_type = 'view' THEN 'at_edit' END, 'now') AS mentee, 'recovered' AS source FROM events WHERE value < 50 AND event_type <> 'error'")
def c13(spark, sf):
    status = F.when(F.col("event_type") == "error", "fetch_failed").when(F.col("value") >= 50, "section_not_found").otherwise("ok")
    e = t(spark, sf, "events").withColumn("status", status).filter("status = 'ok'")
    return e.select("event_id", "status", F.coalesce(F.when(F.col("event_type") == "view", F.lit("at_edit")), F.lit("now")).alias("mentee"), F.lit("recovered").alias("source"))


@query("c15_eligibility", f"WITH {B.TURNS} SELECT conv_id, trim(question) <> '' AS q, reply IS NOT NULL AND trim(reply) <> '' AS r FROM turns")
def c15(spark, sf):
    return B.turns(spark, sf).select("conv_id", (F.trim("question") != "").alias("q"), (F.col("reply").isNotNull() & (F.trim("reply") != "")).alias("r"))


@query("c17_rename_defaults", "SELECT d.doc_id, coalesce(l.quality, 0)::INT AS q_quality, coalesce(l.toxic, 0)::INT AS q_toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def c17(spark, sf):
    j = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left")
    return j.select("doc_id", *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"q_{c}") for c in ("quality", "toxic")])


@query("c18_readable_labels", "SELECT p_partkey, CASE WHEN p_type IN ('STANDARD') THEN 'Standard part' WHEN p_brand LIKE 'Brand#1%' THEN 'First brand ' || substr(p_brand, 7) ELSE p_brand END AS label FROM part")
def c18(spark, sf):
    exact = F.create_map(F.lit("STANDARD"), F.lit("Standard part"))
    return t(spark, sf, "part").select("p_partkey", F.coalesce(exact[F.col("p_type")], F.when(F.col("p_brand").startswith("Brand#1"), F.concat(F.lit("First brand "), F.substring("p_brand", 7, 100))).otherwise(F.col("p_brand"))).alias("label"))


# -- joins --------------------------------------------------------------------------------------------------------------------


@query("d01_lookup_last_wins", "SELECT o.o_orderkey, b.event_id FROM orders o LEFT JOIN (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) b ON b.user_id = o.o_custkey")
def d01(spark, sf):
    probe = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    build = t(spark, sf, "events").select("user_id", "event_id")
    return seq.lookup_last(probe, build, ["user_id"], "event_id", "event_id").select("o_orderkey", "event_id")


_TIERS = """tags AS (SELECT l_orderkey AS owner, l_suppkey AS name, strftime(l_shipdate, '%Y%m%d-%H%M') AS minute, l_returnflag = 'R' AS reverted FROM lineitem),
 parsed AS (SELECT l_orderkey AS owner, l_suppkey AS name, CASE WHEN l_tax > 0.03 THEN strftime(l_shipdate, '%Y%m%d-%H%M') ELSE 'x' END AS minute FROM lineitem WHERE l_discount > 0.02),
 tiers AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM parsed p WHERE p.owner = t.owner AND p.name = t.name AND p.minute = t.minute) THEN 'matched' WHEN EXISTS (SELECT 1 FROM parsed p WHERE p.owner = t.owner AND p.name = t.name) THEN 'name_only' ELSE 'missing' END AS tier FROM tags t)"""


def _tiers(spark, sf):
    l = t(spark, sf, "lineitem")
    minute = F.date_format("l_shipdate", "yyyyMMdd-HHmm")
    tags = l.select(F.col("l_orderkey").alias("owner"), F.col("l_suppkey").alias("name"), minute.alias("minute"), (F.col("l_returnflag") == "R").alias("reverted"))
    parsed = l.filter("l_discount > 0.02").select(F.col("l_orderkey").alias("owner"), F.col("l_suppkey").alias("name"), F.when(F.col("l_tax") > 0.03, minute).otherwise("x").alias("minute"))
    return seq.coverage_tiers(tags, parsed, "owner", "name", "minute")


@query("d02_coverage_tiers", f"WITH {_TIERS} SELECT tier, reverted, count(*) AS n FROM tiers GROUP BY ALL")
def d02(spark, sf):
    return _tiers(spark, sf).groupBy("tier", "reverted").agg(F.count("*").alias("n"))


@query(
    "e04_coverage_report",
    f"WITH {_TIERS} SELECT owner, count(*) AS total, count(*) FILTER (tier = 'matched') AS matched, count(*) FILTER (tier = 'name_only') AS name_only, count(*) FILTER (tier = 'missing') AS missing, count(*) FILTER (tier = 'missing' AND reverted) AS missing_reverted, "
    "count(*) FILTER (tier = 'missing' AND NOT reverted) AS missing_not_reverted, round_even(100 * count(*) FILTER (tier = 'matched') / greatest(count(*), 1), 1) AS matched_pct FROM tiers GROUP BY ROLLUP (owner)",
)
def e04(spark, sf):
    return seq.coverage_report(_tiers(spark, sf), "owner", F.col("reverted"))


@query("d04_semi_and_anti", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents")
def d04(spark, sf):
    d, l = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_semi").withColumn("known", F.lit(True)).union(d.join(l, "doc_id", "left_anti").withColumn("known", F.lit(False)))


@query("d10_enrichment", "SELECT d.doc_id, d.lang, l.quality, v.label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings v ON v.vec_id = d.doc_id")
def d10(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.join(t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").select("doc_id", "lang", "quality", "label")


@query("d11_d12_d13_vector_lookup", "SELECT d.doc_id, coalesce(round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5), 0) AS energy FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id * 2")
def d11(spark, sf):
    v = t(spark, sf, "embeddings").select("vec_id", "embedding")
    j = t(spark, sf, "documents").select("doc_id").join(v, F.col("vec_id") == F.col("doc_id") * 2, "left")
    e = F.coalesce(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), 64))
    return j.select("doc_id", F.round(C.dot(e, e), 5).alias("energy"))


@query("d15_e33_a22_utterances", f"WITH {_CONV} SELECT 'q_' || id AS conversation, 'q_' || id AS utterance, mentee AS speaker, NULL AS reply_to, asked_us AS us, question AS text FROM conv UNION ALL SELECT 'q_' || id, 'r_' || id, speaker, 'q_' || id, replied_us, reply FROM conv WHERE has_reply")
def d15(spark, sf):
    return K.utterances(_cleaned(spark, sf))


@query("d15_speakers", f"WITH {_CONV}, s AS (SELECT mentee AS speaker, id, 0 AS k, 'mentee' AS role FROM conv UNION ALL SELECT mentor, id, 1, 'mentor' FROM conv UNION ALL SELECT speaker, id, 2, 'other_responder' FROM conv WHERE has_reply AND speaker <> mentor) SELECT speaker, arg_min(role, id * 3 + k) AS role FROM s GROUP BY speaker")
def d15b(spark, sf):
    return K.speakers(_cleaned(spark, sf))


@query("e33_corpus_totals", f"WITH {_CONV}, s AS (SELECT mentee AS speaker, id, 0 AS k, 'mentee' AS role FROM conv UNION ALL SELECT mentor, id, 1, 'mentor' FROM conv UNION ALL SELECT speaker, id, 2, 'other_responder' FROM conv WHERE has_reply AND speaker <> mentor), r AS (SELECT speaker, arg_min(role, id * 3 + k) AS role FROM s GROUP BY speaker) SELECT (SELECT count(*) FROM conv) AS conversations, (SELECT count(*) + count(*) FILTER (has_reply) FROM conv) AS utterances, (SELECT count(*) FILTER (has_reply) FROM conv) AS replies, count(*) AS speakers, count(*) FILTER (role = 'mentee') AS mentees, count(*) FILTER (role = 'mentor') AS mentors, count(*) FILTER (role = 'other_responder') AS other_responders FROM r")
def e33(spark, sf):
    c = _cleaned(spark, sf)
    return K.totals(K.utterances(c), K.speakers(c))


@query("a22_corpus_files", f"WITH {_CONV}, u AS (SELECT count(*) AS q, count(*) FILTER (has_reply) AS r FROM conv) SELECT 'utterances' AS file, (SELECT q + r FROM u) AS n UNION ALL SELECT 'corpus', 1 UNION ALL SELECT 'index', 6 + 2 + 2 UNION ALL SELECT 'questions', (SELECT q FROM u)")
def a22(spark, sf):
    """The corpus exported as files and read again: rows of each, and what the metadata say."""
    c = _cleaned(spark, sf)
    u = K.utterances(c)
    n = u.agg(F.count_if(F.col("reply_to").isNull()).alias("q"), F.count("reply_to").alias("r")).first()
    io.export_corpus(folder := io.scratch(spark, "corpus"), {"num_questions": n.q, "num_replies": n.r}, utterances=u, speakers=K.speakers(c))
    rows = [spark.read.json(f"{folder}/{k}").agg(F.lit(k).alias("file"), F.count("*").alias("n")) for k in ("utterances", "corpus", "index")]
    return rows[0].union(rows[1]).union(rows[2]).union(spark.read.json(f"{folder}/corpus").select(F.lit("questions"), "num_questions"))


@query("d16_role_union", "SELECT name, list_sort(list(DISTINCT role)) AS roles FROM (SELECT c_name AS name, 'mentor' AS role FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_name, 'mentor' FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT c_name, 'mentee' FROM customer WHERE c_acctbal > 0) GROUP BY name")
def d16(spark, sf):
    c = t(spark, sf, "customer").withColumn("name", F.col("c_name"))
    return seq.role_union([c.filter("c_mktsegment = 'BUILDING'"), c.filter("c_acctbal > 8000")], c.filter("c_acctbal > 0"))


@query("d17_resolve_ids", "SELECT c_name AS name, coalesce(CASE WHEN c_acctbal > 5000 THEN c_custkey END, CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey END) AS id FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'")
def d17(spark, sf):
    c = t(spark, sf, "customer").withColumns({"name": F.col("c_name"), "id": F.col("c_custkey")})
    return seq.resolve_ids(c, c.filter("c_acctbal > 5000"), c.filter("c_mktsegment = 'BUILDING'").withColumn("id", -F.col("id")))


# -- reports ------------------------------------------------------------------------------------------------------------------


@query("e02_summary", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS most FROM documents GROUP BY 1")
def e02(spark, sf):
    d = t(spark, sf, "documents")
    sums = d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("most"))
    q = St.quantiles(d, "n_chars", [0.5], ["lang"])
    return St.meet(sums, q, ["lang"], "left").select("lang", "n", "mean", F.get("quantiles", F.lit(0)).alias("median"), "most")


_P = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


@query("e25_m11_percentiles", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, " + ", ".join(f"round(quantile_cont(n_chars, {p}), 6) AS p{round(100 * p)}" for p in _P) + ", max(n_chars) AS max FROM documents GROUP BY 1")
def e25(spark, sf):
    out = St.summary(t(spark, sf, "documents"), "n_chars", ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("lang", "n", "min", "max")})


@query("e43_describe", "SELECT 'l_quantity' AS variable, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.5) AS median, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), quantile_cont(l_discount, 0.5), max(l_discount) FROM lineitem")
def e43(spark, sf):
    long = t(spark, sf, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("x")) for c in ("l_quantity", "l_discount")])).alias("v")).select("v.*")
    out = St.summary(long, "x", ["variable"], [0.5])
    return out.select("variable", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", F.col("p50").alias("median"), "max")


@query("e44_pivot", "SELECT lang, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def e44(spark, sf):
    j = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id")
    p = j.groupBy("lang").pivot("quality", [0, 1]).count()
    return p.select("lang", F.coalesce("0", F.lit(0)).alias("bad"), F.coalesce("1", F.lit(0)).alias("good"))


@query("e47_run_summary", f"WITH {B.TURNS} SELECT count(*) AS conversations, count(reply) AS replies, round(count(reply) / greatest(count(*), 1), 6) AS reply_rate FROM turns")
def e47(spark, sf):
    n, r = F.count("*"), F.count("reply")
    return B.turns(spark, sf).agg(n.alias("conversations"), r.alias("replies"), F.round(r / F.greatest(n, F.lit(1)), 6).alias("reply_rate"))


@query("e48_label_distribution", "SELECT d AS dimension, v AS value, count(*) AS n FROM (SELECT unnest(['quality', 'toxic']) AS d, unnest([quality, toxic]) AS v FROM labels) GROUP BY ALL")
def e48(spark, sf):
    long = t(spark, sf, "labels").select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("quality", "toxic")])).alias("x")).select("x.*")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query("e49_collection_report", "SELECT count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS failing, (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' AND value > 40 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)) AS both_roles FROM events")
def e49(spark, sf):
    e = t(spark, sf, "events")
    both = e.filter("event_type = 'view' AND value > 40").select("user_id").intersect(e.filter("event_type = 'error' AND value > 100").select("user_id"))
    kind = lambda k: F.count_distinct(F.when(F.col("event_type") == k, F.col("user_id")))
    return e.agg(kind("view").alias("viewers"), kind("error").alias("failing")).crossJoin(both.agg(F.count("*").alias("both_roles")))  # one row each


@query("m09_missing_ids", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def m09(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id").join(t(spark, sf, "labels"), F.col("vec_id") == F.col("doc_id"), "left_anti")


@query("m12_before_after", "SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT source, count(*) AS n FROM documents WHERE n_chars > 1000 GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1) b USING (source)")
def m12(spark, sf):
    d = t(spark, sf, "documents")
    a = d.filter("n_chars > 1000").groupBy("source").agg(F.count("*").alias("before"))
    b = d.filter("lang <> 'en'").groupBy("source").agg(F.count("*").alias("after"))
    return a.join(b, "source", "full").select("source", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


@query("m13_fix_classes", f"WITH {B.TURNS} SELECT CASE WHEN reply IS NULL THEN 'unchanged_null' WHEN length(reply) > 400 THEN 'fixed' ELSE 'unchanged' END AS class, count(*) AS n FROM turns GROUP BY 1")
def m13(spark, sf):
    k = F.when(F.col("reply").isNull(), "unchanged_null").when(F.length("reply") > 400, "fixed").otherwise("unchanged")
    return B.turns(spark, sf).groupBy(k.alias("class")).agg(F.count("*").alias("n"))


# -- sorts and sets -----------------------------------------------------------------------------------------------------------


def _ordered(rows, keys):
    """All rows with their position in the order of keys (equal keys share one), which is found by ranges of the order."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(F.struct(*keys).alias("k"), "n")
    places = St.cumulative(counts, "k", ["n"]).select("k.*", (F.col("below_n") + 1).alias("position"))
    return St.meet(rows, places, keys).orderBy("position")


@query("g01_sort", "SELECT event_id, user_id, rank() OVER (ORDER BY ts, user_id) AS position FROM events")
def g01(spark, sf):
    return _ordered(t(spark, sf, "events").select("event_id", "ts", "user_id"), ["ts", "user_id"]).select("event_id", "user_id", "position")


@query("g02_coverage_order", f"WITH {_TIERS}, s AS (SELECT owner, round(count(*) FILTER (tier = 'matched') / greatest(count(*), 1), 6) AS share FROM tiers GROUP BY 1 HAVING count(*) > 0) SELECT owner, share, rank() OVER (ORDER BY share, owner) AS position FROM s")
def g02(spark, sf):
    g = _tiers(spark, sf).groupBy("owner").agg(F.round(F.count_if(F.col("tier") == "matched") / F.greatest(F.count("*"), F.lit(1)), 6).alias("share"))
    return _ordered(g, ["share", "owner"]).select("owner", "share", "position")


@query("g03_top_k", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def g03(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("g04_largest_by_size", "SELECT event_id, value - 50 AS v FROM events ORDER BY abs(value - 50) DESC, event_id LIMIT 15")
def g04(spark, sf):
    from threadloom.operators.linear import rank_by_size

    return rank_by_size(t(spark, sf, "events").select("event_id", (F.col("value") - 50).alias("v")), "v", 15, "event_id")


@query("g05_top_per_group", "SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 10")
def g05(spark, sf):
    return seq.top_per_group(t(spark, sf, "documents").select("lang", "doc_id", "n_chars"), ["lang"], 10, F.desc("n_chars"), F.col("doc_id"))


@query("g06_both_tails", "(SELECT event_id, value, 'top' AS tail FROM events ORDER BY value DESC, event_id LIMIT 15) UNION ALL (SELECT event_id, value, 'bottom' FROM events ORDER BY value, event_id LIMIT 15)")
def g06(spark, sf):
    return seq.both_tails(t(spark, sf, "events").select("event_id", "value"), 15, "value", "event_id")


@query("f13_h05_first_wins", "SELECT lower(c_mktsegment) AS k, c_custkey AS pos, src FROM (SELECT c_mktsegment, c_custkey, 0 AS src FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_mktsegment, c_custkey, 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY src, c_custkey) = 1")
def f13(spark, sf):
    c = t(spark, sf, "customer")
    rows = lambda x, src: x.select(F.lower("c_mktsegment").alias("k"), F.col("c_custkey").alias("pos"), F.lit(src).alias("src"))
    return seq.first_wins([rows(c.filter("c_acctbal > 0"), 0), rows(c, 1)], ["k"], "pos")


@query("f14_cell_sort", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7 DESC, vec_id)::INT AS place FROM embeddings")
def f14(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy(F.desc(F.col("vec_id") % 7), "vec_id")
    return t(spark, sf, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("place"))


@query("h01_tagged_union", "SELECT c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def h01(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("source")).unionByName(t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("source")))


@query("h03_difference", "SELECT user_id FROM events WHERE event_type = 'view' AND value > 150 EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100")
def h03(spark, sf):
    e = t(spark, sf, "events")
    return e.filter("event_type = 'view' AND value > 150").select("user_id").subtract(e.filter("event_type = 'error' AND value > 100").select("user_id"))


@query("h04_array_minus", "SELECT user_id, list_sort(list_filter(list(DISTINCT event_type), lambda x: x NOT IN ('view', 'error'))) AS rest FROM events GROUP BY 1")
def h04(spark, sf):
    g = t(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return g.select("user_id", F.array_sort(F.array_except("s", F.array(F.lit("view"), F.lit("error")))).alias("rest"))


@query("b26_yes_no", "SELECT doc_id, CASE WHEN quality = 1 THEN 'Y' ELSE 'N' END AS yn FROM labels")
def b26(spark, sf):
    return t(spark, sf, "labels").select("doc_id", X.to_yn(F.when(F.col("quality") == 1, " y ").otherwise("maybe")).alias("yn"))


@query("b28_codebook_rule", "SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1")
def b28(spark, sf):
    return t(spark, sf, "labels").filter("quality = 0 AND toxic = 1").select("doc_id")
