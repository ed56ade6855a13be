"""Queries of text functions and markup parsing. Prose stands in for messages; markup is made from it and from ids, in many forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import wikitext as M
from threadloom.operators import sequence as seq
from threadloom.plans import bindings as B
from threadloom.plans.registry import query

t = B.table
_D = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)"
_SENT = "CASE WHEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE greatest(1, len(regexp_split_to_array(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '[.!?]+')) - 1) END"


#: Markup is made by expressions that both engines read, so that the SQL judges the same varied texts by its own means.
_K = "c_custkey"


def _made(spark, sf, table, **columns):
    """A table with columns made by such expressions."""
    return t(spark, sf, table).select("*", *[F.expr(e).alias(c) for c, e in columns.items()])


def _docs(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


def _round(columns):
    return [(F.round(c, 6) if "avg" in k or "ratio" in k or k in ("fk_grade",) else c).alias(k) for k, c in columns.items()]


def _rx(p):
    """A pattern for RE2, whose \\b knows ASCII only."""
    p = "(?:^|[^\\pL\\pN_])" + p[2:] if p.startswith(r"\b") else p
    p = p[:-2] + "(?:$|[^\\pL\\pN_])" if p.endswith(r"\b") else p
    return "'" + p.replace("'", "''") + "'"


@query("b01_norm_user", "SELECT c_custkey, trim(replace(c_name, '#', ' ')) AS name FROM customer")
def b01(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", X.norm_user(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(" "))).alias("name"))


_MENTORS = f"""'intro' || chr(10) || CASE {_K} % 3 WHEN 0 THEN 'see * ' WHEN 1 THEN '* ' ELSE '  *' END || CASE {_K} % 5 WHEN 0 THEN '[[Help:A]]' WHEN 1 THEN '[[user:' || c_name || '|x]]' ELSE '[[User: ' || c_name || ']]' END
 || CASE {_K} % 4 WHEN 0 THEN ' - ' WHEN 1 THEN '|' WHEN 2 THEN ' – ' ELSE ' ' END || c_mktsegment || CASE WHEN {_K} % 2 = 0 THEN chr(10) || '*[[User:Second_' || {_K} || ']]' ELSE '' END || chr(10) || 'not * [[User:Z]]'"""


@query("b02_mentor_rows", f"""WITH l AS (SELECT c_custkey, trim(unnest(string_split({_MENTORS}, chr(10)))) AS x FROM customer)
SELECT c_custkey, trim(regexp_extract(x, '(?i)\\[\\[User:([^\\]|]+)', 1)) AS username,
 trim(CASE WHEN regexp_matches(x, '\\]\\]\\|(.+)') THEN regexp_extract(x, '\\]\\]\\|(.+)', 1) WHEN regexp_matches(x, '\\]\\]\\s*[-–—]\\s*(.+)') THEN regexp_extract(x, '\\]\\]\\s*[-–—]\\s*(.+)', 1) ELSE regexp_extract(x, '\\]\\](.+)', 1) END) AS message
FROM l WHERE starts_with(x, '*') AND regexp_matches(x, '(?i)\\[\\[User:[^\\]|]+')""")
def b02(spark, sf):
    return _made(spark, sf, "customer", line=_MENTORS).select("c_custkey", F.explode(M.mentor_rows(F.col("line"))).alias("r")).select("c_custkey", "r.*")


_ENTRY = """'"' || {id} || '":{{"username":"' || c_name || '"' || CASE WHEN c_custkey % 4 > 0 THEN ',"weight":' || (c_custkey % 4) ELSE '' END || ',"message":"' || c_mktsegment || '"}}'"""
_ENTRIES = "'{' || " + _ENTRY.format(id="c_custkey") + " || CASE WHEN c_custkey % 2 = 0 THEN ',' || " + _ENTRY.format(id="(c_custkey + 100000)") + " ELSE '' END || '}'"
_JSON_MENTORS = f"CASE c_custkey % 5 WHEN 0 THEN '{{bad' WHEN 1 THEN '{{\"Mentors\":' || {_ENTRIES} || '}}' WHEN 2 THEN '[1]' ELSE {_ENTRIES} END"


@query("b03_json_mentors", f"""WITH j AS (SELECT c_custkey, {_JSON_MENTORS} AS j FROM customer), o AS (SELECT c_custkey, coalesce(json_extract(j, '$.Mentors'), j::JSON) AS o FROM j WHERE json_valid(j) AND json_type(j) = 'OBJECT'),
u AS (SELECT c_custkey, o, unnest(json_keys(o)) AS uid FROM o)
SELECT c_custkey, uid, json_extract_string(o, '$."' || uid || '".username') AS username, json_extract_string(o, '$."' || uid || '".weight')::INT AS weight, json_extract_string(o, '$."' || uid || '".message') AS message FROM u""")
def b03(spark, sf):
    rows = _made(spark, sf, "customer", j=_JSON_MENTORS).select("c_custkey", F.explode(M.json_mentors(F.col("j"))).alias("uid", "m"))
    return rows.select("c_custkey", "uid", "m.username", "m.weight", "m.message")


@query("b04_content", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS content FROM documents")
def b04(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.struct(F.struct(F.col("lang").alias("content")).alias("main"))).alias("slots"), F.col("source").alias("content"))
    from threadloom.sources.io import content_of

    return content_of(d).select("doc_id", "content")


def _pages(spark, sf):
    """Talk pages made from conversations: a header, the question and an indented reply."""
    c = B.turns(spark, sf)
    flat = lambda x: F.regexp_replace(F.coalesce(x, F.lit("none")), r"[\n\r=:*\[\]{}()|]", " ")
    head = F.concat(F.lit("== Question from [[User:N"), F.col("conv_id"), F.lit("|N]]"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" on [[Page "), F.col("conv_id"), F.lit("]]"))).otherwise(""), F.lit(" (09:05, 7 July 2025) =="))
    body = F.concat(F.lit("\n"), flat(F.col("question")), F.lit("\n:"), flat(F.col("reply")), F.lit("\n== Other ==\nx"))
    return c.select("conv_id", flat(F.col("question")).alias("q"), flat(F.col("reply")).alias("r"), F.concat(head, body).alias("wt"))


_FLAT = "regexp_replace(coalesce({0}, 'none'), '[\\n\\r=:*\\[\\]{{}}()|]', ' ', 'g')"
_PG = f"WITH {B.TURNS}, pg AS (SELECT conv_id, {_FLAT.format('question')} AS q, {_FLAT.format('reply')} AS r FROM turns)"


@query("b05_b09_questions", _PG + " SELECT conv_id, 'N' || conv_id AS mentee, CASE WHEN conv_id % 2 = 0 THEN 'Page ' || conv_id END AS article, '09:05, 7 July 2025' AS asked, regexp_replace(q || chr(10) || ':' || r, '^\\s+|\\s+$', '', 'g') AS body FROM pg")
def b05(spark, sf):
    return _pages(spark, sf).select("conv_id", F.explode(M.questions(F.col("wt"))).alias("x")).select("conv_id", "x.*")


_HEADER = """CASE c_custkey % 6 WHEN 0 THEN '== Question from [[User:N' || c_custkey || ']] on [[Page]] (09:05, 7 July 2025) ==' WHEN 1 THEN '== Question from [[User:N' || c_custkey || '|alias]] (some day) =='
 WHEN 2 THEN 'x == question FROM [[User:N' || c_custkey || '|a]] hm (09:05 7 July 2025) ==' WHEN 3 THEN '== Question from [[User:N' || c_custkey || ']]' || chr(10) || 'later (09:05, 7 July 2025) =='
 WHEN 4 THEN '=== Question from N' || c_custkey || ' ===' ELSE '== Question from [[User:N' || c_custkey || ']] (09:05, 7 July 2025)  == ' || c_mktsegment END"""
_HEADERS = "'first line' || chr(10) || " + _HEADER + " || chr(10) || c_name"


@query("b06_header_dialects", f"SELECT c_custkey, {', '.join(f'regexp_matches({_HEADERS}, {chr(39)}{p}{chr(39)}) AS {k}' for k, p in M.HEADERS.items())} FROM customer")
def b06(spark, sf):
    return _made(spark, sf, "customer", wt=_HEADERS).select("c_custkey", *[F.col("wt").rlike(p).alias(k) for k, p in M.HEADERS.items()])


_TITLE = "CASE page_id % 4 WHEN 0 THEN 'User talk:' || url WHEN 1 THEN 'User talk:U ' || page_id WHEN 2 THEN 'Talk:' || url ELSE 'User talk:U' || page_id || '/Archive/' || page_id END"


@query("b07_mentor_from_title", f"SELECT page_id, CASE WHEN starts_with({_TITLE}, 'User talk:') THEN regexp_extract(substr({_TITLE}, 11), '^[^/]*') END AS mentor FROM pages")
def b07(spark, sf):
    return _made(spark, sf, "pages", title=_TITLE).select("page_id", M.mentor_from_title(F.col("title")).alias("mentor"))


@query("b08_wiki_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS iso FROM events")
def b08(spark, sf):
    month = F.get(F.array(*[F.lit(m.title()) for m in M.MONTHS]), F.month("ts") - 1)
    text = F.concat(F.date_format("ts", "HH:mm"), F.lit(", "), F.dayofmonth("ts"), F.lit(" "), month, F.lit(" "), F.year("ts"), F.lit(" (UTC)"))
    return t(spark, sf, "events").select("event_id", M.parse_wiki_time(text).alias("iso"))


@query("b10_find_section", _PG + " SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'N' || conv_id WHEN 1 THEN 'Zed' ELSE 'Last' END AS found, CASE conv_id % 3 WHEN 0 THEN regexp_replace(q || chr(10) || ':' || r, '^\\s+|\\s+$', '', 'g') WHEN 1 THEN 'hi' ELSE 'bye' END AS body FROM pg")
def b10(spark, sf):
    page = F.concat(F.lit("== Question from [[User:Zed]] (01:00, 1 May 2024) ==\nhi\n"), "wt", F.lit("\n== Question from [[User:Last]] (02:00, 1 May 2024) ==\nbye\n"))
    p = _pages(spark, sf).withColumn("all", M.questions(page))
    who = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("n"), F.col("conv_id"))).when(F.col("conv_id") % 3 == 1, "zED").otherwise("nobody")
    found = M.find_section(F.col("all"), who)
    return p.select("conv_id", found["mentee"].alias("found"), found["body"].alias("body"))


_MIDDLE = "CASE page_id % 5 WHEN 0 THEN ' on [[A ' || page_id || ']] and on [[B]]' WHEN 1 THEN ' on [[]] ' WHEN 2 THEN 'on[[C]] on [[' || substr(url, 1, 12) || ']]' WHEN 3 THEN '' ELSE ' upon [[D|' || page_id || ']]' END"


@query("b11_article", f"SELECT page_id, nullif(regexp_extract({_MIDDLE}, 'on \\[\\[([^\\]]+)\\]\\]', 1), '') AS article FROM pages")
def b11(spark, sf):
    return _made(spark, sf, "pages", middle=_MIDDLE).select("page_id", M.extract_article(F.col("middle")).alias("article"))


@query("b12_split_reply", _PG + " SELECT conv_id, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS question, ':' || regexp_replace(r, '\\s+$', '') AS reply FROM pg")
def b12(spark, sf):
    body = F.concat(F.lit(": [[User talk:M]] is away\n"), "q", F.lit("\n:"), "r")
    return _pages(spark, sf).select("conv_id", *[c.alias(k) for k, c in M.split_reply(body).items()])


@query("b13_b14_reply_only", _PG + " SELECT conv_id, CASE WHEN trim(r) <> '' THEN 'R ' || trim(r) END AS rest, CASE WHEN length(q) >= 50 THEN NULL ELSE 'x' END AS fixed FROM pg")
def b13(spark, sf):
    p = _pages(spark, sf).withColumn("head", F.concat(F.lit("line one\n "), F.trim("q")))
    rest = M.reply_only(F.col("head"), F.concat(F.lit("line one \n"), F.trim("q"), F.lit("\nR "), F.trim("r")))
    return p.select("conv_id", F.when(F.trim("r") != "", rest).alias("rest"), M.fixed_reply(F.col("q"), F.when(F.length("q") >= 50, F.concat(F.lit("\n"), "q")).otherwise("x")).alias("fixed"))


def _signature(i):
    """The i-th signed piece of a reply: whether it is there and links a user within 500 characters, its signer, time and text."""
    has = f"(c_custkey + {i}) % 4 <> 0"
    link = f"CASE (c_custkey + {i}) % 3 WHEN 0 THEN '[[User:M_' || c_custkey || '|me]]' WHEN 1 THEN '[[User talk:Other One#x|o]]' ELSE '[[user:Ann_B C|a]]' END"
    month = f"CASE c_custkey % 3 WHEN 0 THEN 'March' WHEN 1 THEN 'may' ELSE 'DECEMBER' END"
    clock = f"'0{i + 5}:' || lpad(CAST(c_custkey % 60 AS STRING), 2, '0')"
    time = f"{clock} || ', ' || (1 + c_custkey % 28) || ' ' || CASE WHEN (c_custkey + {i}) % 7 = 0 THEN 'Foober' ELSE {month} END || ' 2024 (UTC)'"
    iso = f"CASE WHEN (c_custkey + {i}) % 7 > 0 THEN '2024-' || CASE c_custkey % 3 WHEN 0 THEN '03' WHEN 1 THEN '05' ELSE '12' END || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || 'T' || {clock} || ':00Z' END"
    signer = f"CASE (c_custkey + {i}) % 3 WHEN 0 THEN 'm ' || c_custkey WHEN 1 THEN 'other one' ELSE 'ann b c' END"
    text = f"CASE WHEN c_custkey % 4 >= {i} THEN c_mktsegment || CASE WHEN {has} THEN ' ' || {link} || ' ' ELSE repeat(' z', 300) END || {time} || chr(10) ELSE '' END"
    return {"there": f"c_custkey % 4 >= {i}", "has": has, "signer": signer, "iso": iso, "text": text}


_SIGS = [_signature(i) for i in (1, 2, 3)]
_RAW = "'Hi there ' || " + " || ".join(x["text"] for x in _SIGS)
# A piece ends with a line break after its time.
_SIGNED = "sig AS (SELECT c_custkey, " + _RAW + " AS raw, list_filter([" + ", ".join(
    f"{{'ok': {x['there']} AND {x['has']}, 's': {x['signer']}, 't': {x['iso']}, 'e': length('Hi there ' || {' || '.join(y['text'] for y in _SIGS[: k + 1])}) - 1}}" for k, x in enumerate(_SIGS)
) + f"], lambda x: x.ok) AS l, CASE WHEN c_custkey % 4 > 0 THEN {_SIGS[0]['iso']} END AS first_time FROM customer), own AS (SELECT *, list_filter(l, lambda x: x.s = 'm ' || c_custkey) AS o FROM sig)"


def _signed(spark, sf):
    """Replies with up to three signatures: of the mentor, of others, without a user, with unreadable months."""
    c = _made(spark, sf, "customer", raw=_RAW, mentor="'M_' || c_custkey")
    return c.withColumn("sigs", M.signatures(F.col("raw")))


@query("b15_b18_signatures", f"WITH {_SIGNED} SELECT c_custkey, len(l)::INT AS n, l[1].s AS first_signer, l[1].t AS first_ts, l[1].e::INT AS first_end, list_sort(list_distinct(list_transform(l, lambda x: x.s))) AS signers FROM sig")
def b15(spark, sf):
    first = F.get("sigs", F.lit(0))
    return _signed(spark, sf).select("c_custkey", F.size("sigs").alias("n"), first["signer"].alias("first_signer"), first["ts"].alias("first_ts"), first["end"].alias("first_end"), M.signers(F.col("sigs")).alias("signers"))


@query("f15_b16_reply_time", f"WITH {_SIGNED} SELECT c_custkey, CASE WHEN len(o) > 0 THEN o[1].t ELSE first_time END AS ts FROM own")
def b16(spark, sf):
    return _signed(spark, sf).select("c_custkey", M.reply_time(F.col("raw"), F.col("sigs"), F.col("mentor")).alias("ts"))


@query("b17_truncated_reply", f"WITH {_SIGNED} SELECT c_custkey, CASE WHEN len(l) >= 2 AND len(o) > 0 THEN substr(raw, 1, o[1].e) ELSE raw END AS cut FROM own")
def b17(spark, sf):
    return _signed(spark, sf).select("c_custkey", M.truncate_reply(F.col("raw"), F.col("sigs"), F.col("mentor")).alias("cut"))


_ASKED = "CASE WHEN c_custkey % 5 = 0 THEN 'Why, ' || c_custkey || '?' ELSE 'How do I cite a ' || lower(c_mktsegment) || ' catalogue of ' || c_name || ' that is not online?' END"
_ANSWERED = f"CASE WHEN c_custkey % 2 = 0 THEN '{{{{tq}}}} ' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'Well, ' ELSE '' END || {_ASKED} || ' [[User:' || CASE WHEN c_custkey % 4 > 0 THEN 'N_' || c_custkey ELSE 'Z' END || ']] 10:00, 3 March 2024 (UTC)' || chr(10) || ' Answer ' || c_custkey"


@query("b19_repeated_question", f"SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 3 > 0 AND c_custkey % 4 > 0 THEN 'Answer ' || c_custkey ELSE {_ANSWERED} END AS reply FROM customer")
def b19(spark, sf):
    c = _made(spark, sf, "customer", q=_ASKED, r=_ANSWERED, mentee="'N ' || c_custkey")
    return c.select("c_custkey", M.strip_repeated_question(F.col("q"), F.col("r"), M.signatures(F.col("r")), F.col("mentee")).alias("reply"))


@query("b20_section_cut", "SELECT doc_id, coalesce(text, '') AS first_part FROM documents")
def b20(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", M.section_cut(F.concat("t", F.lit("\n== Next ==\nmore"))).alias("first_part"))


@query("b21_clean_wikitext", _PG + " SELECT conv_id, trim(regexp_replace(q, '[^A-Za-z]+', ' ', 'g')) || ' [POLICY] [WIKILINK] [LINK]' AS clean FROM pg")
def b21(spark, sf):
    p = _pages(spark, sf)
    raw = F.concat(F.lit(":* "), F.trim(F.regexp_replace("q", "[^A-Za-z]+", " ")), F.lit(" [[WP:N|n]] [[WP:RS]] [[Some page]] <b>https://x.org/a</b> {{clear}} '' -- [[User:A B|A]] ([[User talk:A B|talk]]) 10:00, 3 March 2024 (UTC)"))
    return p.select("conv_id", M.clean_wikitext(raw).alias("clean"))


_EMB = """'Hello @' || CASE WHEN c_custkey % 2 = 0 THEN 'New(user)+_' ELSE 'New(user)+ ' END || c_custkey || ' , thanks for ' || lower(c_mktsegment) || ' item' || c_nationkey || ' ok'
 || CASE WHEN c_custkey % 3 = 0 THEN ' 01234 5678-9' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ' (Talk page)' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' mentor.x' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '?' ELSE ' .' END"""


@query("b22_embedding_text", "SELECT c_custkey, 'Hello, thanks for ' || lower(c_mktsegment) || ' item' || c_nationkey || ' ok' || CASE WHEN c_custkey % 7 = 0 THEN '?' ELSE '.' END AS emb FROM customer")
def b22(spark, sf):
    c = _made(spark, sf, "customer", clean=_EMB, mentee="'New(user)+_' || c_custkey")
    return c.select("c_custkey", M.embedding_text(F.col("clean"), F.col("mentee"), F.lit("Mentor.X")).alias("emb"))


@query("b23_is_english", "SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 3 OR length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) = 0 OR length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) >= 0.95 * length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) AS english FROM documents")
def b23(spark, sf):
    return _docs(spark, sf).select("doc_id", X.is_english(F.col("t"), 0.95).alias("english"))


@query("b24_signer_classes", """WITH b AS (SELECT c_custkey, c_custkey % 2 = 1 AS m, c_custkey // 2 % 2 = 1 AS x, c_custkey // 4 % 2 = 1 AS n, c_custkey % 5 > 0 AS r, c_mktsegment AS o, 'm ' || c_custkey AS me FROM customer),
k AS (SELECT *, CASE WHEN NOT r THEN 'none' WHEN m AND x THEN 'mentor_and_other' WHEN m THEN 'assigned_mentor' WHEN x THEN 'other_only' ELSE 'none' END AS k FROM b)
SELECT c_custkey, k AS reply_signer, CASE WHEN k = 'none' THEN [] ELSE list_sort(list_filter([CASE WHEN m THEN me END, CASE WHEN x THEN lower(o) END], lambda z: z IS NOT NULL)) END AS actual_responders, k <> 'none' AS has_reply FROM k""")
def b24(spark, sf):
    bit = lambda k: F.floor(F.col("c_custkey") / k) % 2 == 1
    found = F.array_compact(F.array(F.when(bit(4), F.concat(F.lit("n "), "c_custkey")), F.when(bit(2), F.lower("c_mktsegment")), F.when(bit(1), F.concat(F.lit("m "), "c_custkey"))))
    mentor, mentee = F.concat(F.lit("M_"), "c_custkey"), F.concat(F.lit(" N "), "c_custkey")
    return t(spark, sf, "customer").select("c_custkey", *[c.alias(n) for n, c in M.classify_signers(found, mentor, mentee, F.col("c_custkey") % 5 > 0).items()])


_ANSWER = """CASE doc_id % 6 WHEN 0 THEN '```json' || chr(10) || '{"Q0": "' || a || '", "Q2": "' || b || '"}' || chr(10) || '```' WHEN 1 THEN 'Sure: "Q0": "' || a || '" and then "Q2" : "' || b || '", more'
 WHEN 2 THEN '{"Q0": "' || a || '", "Q2": "maybe"}' WHEN 3 THEN '{"Q2": "' || b || '"} or {"Q0": "' || a || '"}' WHEN 4 THEN 'x {"Q2":"' || b || '","Q0":"' || a || '","Q9":"Y"} {"Q0":"?"}' ELSE '' END"""
_ANSWERS = "SELECT doc_id, CASE WHEN quality = 1 THEN 'Y' ELSE 'N' END AS a, CASE WHEN toxic = 1 THEN 'Y' ELSE 'N' END AS b FROM labels"


@query("b25_json_answers", f"""WITH l AS ({_ANSWERS}), r AS (SELECT doc_id, replace(replace({_ANSWER}, '```json', ''), '```', '') AS r FROM l),
j AS (SELECT doc_id, r, regexp_extract(r, '\\{{[^}}]*\\}}') AS j, nullif(regexp_extract(r, '"Q0"\\s*:\\s*"([YN])"', 1), '') AS s0, nullif(regexp_extract(r, '"Q2"\\s*:\\s*"([YN])"', 1), '') AS s2 FROM r),
v AS (SELECT *, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.Q0') END AS j0, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.Q2') END AS j2 FROM j)
SELECT doc_id, CASE WHEN j0 IN ('Y', 'N') AND j2 IN ('Y', 'N') THEN j0 WHEN s0 IS NOT NULL AND s2 IS NOT NULL THEN s0 END AS q0, CASE WHEN j0 IN ('Y', 'N') AND j2 IN ('Y', 'N') THEN j2 WHEN s0 IS NOT NULL AND s2 IS NOT NULL THEN s2 END AS q2 FROM v""")
def b25(spark, sf):
    yn = lambda c: F.when(F.col(c) == 1, "Y").otherwise("N")
    l = t(spark, sf, "labels").select("doc_id", yn("quality").alias("a"), yn("toxic").alias("b")).select("doc_id", F.expr(_ANSWER).alias("raw"))
    labels = M.json_labels(F.col("raw"), ["Q0", "Q2"])
    return l.select("doc_id", labels["Q0"].alias("q0"), labels["Q2"].alias("q2"))


@query("b27_annotations", "SELECT doc_id AS cid, max(quality)::INT AS q0 FROM labels WHERE doc_id % 4 > 0 GROUP BY 1")
def b27(spark, sf):
    l = t(spark, sf, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("cid"), F.concat(F.lit("q_"), "doc_id").alias("id"), F.when(F.col("quality") == 1, "Y").otherwise("N").alias("Q0"), F.when(F.col("doc_id") % 4 == 0, "timeout").alias("error"), F.col("doc_id").alias("pos"))
    l = l.withColumn("cid", F.coalesce("cid", F.regexp_replace("id", "^q_", "").cast("long")))
    out = seq.last_valid(l, "cid", "pos", F.col("error").isNull() & F.col("Q0").isNotNull())
    return out.select("cid", (F.col("Q0") == "Y").cast("int").alias("q0"))


_TF = f"""SELECT doc_id, len(w)::BIGINT AS q_words, length(t) AS q_chars, ({_SENT})::BIGINT AS q_sentences, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END, 6) AS q_avg_word_len,
 round(CASE WHEN len(w) > 0 THEN len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) ELSE 0 END, 6) AS q_type_token_ratio, round(len(w) / greatest({_SENT}, 1), 6) AS q_avg_sentence_len, ({_SENT} <= 1 AND t <> '')::INT AS q_is_single_sentence,
 ((length(t) - length(replace(t, chr(10) || chr(10), ''))) // 2 + CASE WHEN t = '' THEN 0 ELSE 1 END)::BIGINT AS q_n_paragraphs, (length(t) - length(replace(t, '?', '')))::BIGINT AS q_n_question_marks, (length(t) - length(replace(t, '!', '')))::BIGINT AS q_n_exclamation, contains(t, '?')::INT AS q_has_question_mark,
 """ + ", ".join(f"regexp_matches(lower(t), {_rx(p)})::INT AS q_{k}" for k, p in ({"has_greeting": X.GREETING} | X.FLAGS | X.TOPICS).items()) + """, regexp_matches(t, '(?m)^\\s*[\\*\\-\\#\\d]')::INT AS q_has_list,
 """ + ", ".join(f"((length(t) - length(replace(t, '{p}', ''))) // {len(p)})::BIGINT AS q_{k}" for k, p in X.TOKENS.items()) + " FROM d"


@query("i01_text_features", _D + " " + _TF)
def i01(spark, sf):
    out = X.with_text_features(_docs(spark, sf), "t", "q").drop("t")
    return out.select("doc_id", *_round({c: F.col(c) for c in out.columns if c != "doc_id"}))


_WIKI = """CASE doc_id % 4 WHEN 0 THEN ':: ' WHEN 1 THEN ' *' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' [[WP:A]] and [[Help:B|b]] wp:c' ELSE ' [[A]]' END || CASE WHEN doc_id % 5 = 0 THEN ' {{tl|x}} HTTP://a.b' ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN ' {{unsigned|A}}' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' --' || chr(10) || '10:00, 3 March 2024 (UTC) [[more]] {{x}}' ELSE '' END"""
_TIME = r"\d{2}:\d{2},\s*\d{1,2}\s+\w+\s+\d{4}\s*\(UTC\)"


@query("i02_wiki_features", f"""WITH r AS (SELECT doc_id, {_WIKI} AS t FROM documents), c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(t, '{_TIME}') THEN regexp_extract(t, '(?s)^(.*?){_TIME}', 1) ELSE t END, '^\\s+|\\s+$', '', 'g'), '[—–~\\-]{{2,}}\\s*$', ''), '^\\s+|\\s+$', '', 'g') AS b FROM r)
SELECT doc_id, regexp_matches(t, '{_TIME}')::INT AS has_signature, regexp_matches(t, '(?i)\\{{\\{{unsigned|Preceding unsigned comment added by')::INT AS has_unsigned,
 len(regexp_extract_all(b, '\\[\\[.+?\\]\\]')) AS link_count, len(regexp_extract_all(b, '\\{{\\{{.+?\\}}\\}}')) AS template_count, contains(lower(b), 'http')::INT AS has_url, len(regexp_extract_all(b, '(?i)WP:')) AS mentions_wp, len(regexp_extract_all(b, '(?i)Help:')) AS mentions_help,
 (starts_with(b, ':') OR starts_with(b, '*'))::INT AS is_indented, length(b) AS body_char_len, len(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) AS body_word_count FROM c""")
def i02(spark, sf):
    d = _made(spark, sf, "documents", raw=_WIKI)
    return d.select("doc_id", *[c.alias(k) for k, c in X.wiki_features(F.col("raw")).items()])


@query("i03_politeness", "WITH d AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '^\\s+|\\s+$', '', 'g') AS t FROM conversations) SELECT conv_id, turn, " + ", ".join(f"regexp_matches(t, {_rx(p)})::INT AS polite_{k}" for k, p in X.POLITENESS.items()) + " FROM d")
def i03(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in X.politeness(F.col("text")).items()])


_CHAIN = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+(?:''+[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+)*"
_PRON = ", ".join(f"len(list_filter(c, lambda z: z IN ({', '.join(chr(39) + x + chr(39) for x in v)})))::BIGINT AS n_{k}" for k, v in X.PRONOUNS.items())


@query(
    "i04_pronouns",
    f"WITH d AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n, regexp_extract_all(lower(coalesce(text, '')), '{_CHAIN}') AS c FROM conversations), p AS (SELECT conv_id, turn, n, {_PRON} FROM d) SELECT conv_id, turn, n_you, n_i, n_we, "
    + ", ".join(f"round(n_{k} / greatest(n, 1), 9) AS rate_{k}" for k in X.PRONOUNS) + " FROM p",
)
def i04(spark, sf):
    found = X.pronoun_rates(F.col("text"))
    return t(spark, sf, "conversations").select("conv_id", "turn", *[(F.round(c, 9) if k.startswith("rate") else c).alias(k) for k, c in found.items()])


@query("i04_pronouns_documents", f"WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_CHAIN}') AS c FROM documents) SELECT doc_id, {_PRON} FROM d")
def i04_documents(spark, sf):
    return _docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in X.pronoun_counts(F.col("t")).items()])


def _syl(w):
    n = f"len(regexp_extract_all(lower({w}), '[aeiouy]+'))"
    return f"CASE WHEN length({w}) <= 2 THEN 1 ELSE greatest(1, {n} - CASE WHEN ends_with(lower({w}), 'e') AND {n} > 1 THEN 1 ELSE 0 END) END"


@query("i05_syllables", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM benchmark) SELECT w, ({_syl('w')})::BIGINT AS n FROM w")
def i05(spark, sf):
    w = t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", X.syllables(F.col("w")).alias("n"))


@query("i06_readability", f"WITH d AS (SELECT item_id, regexp_extract_all(text, '[a-zA-Z]+') AS w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ' || chr(10)) <> '')) AS s FROM benchmark), e AS (SELECT item_id, len(w) AS n, greatest(s, 1) AS s, list_sum(list_transform(w, lambda x: {_syl('x')})) AS y FROM d) SELECT item_id, round(0.39 * n / s + 11.8 * y / n - 15.59, 6) AS fk_grade, round(y / n, 6) AS avg_syllables FROM e")
def i06(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", *_round(X.readability(F.col("text"))))


_STEPS = """CASE doc_id % 5 WHEN 0 THEN '1. ' WHEN 1 THEN 'see Step ' || doc_id || ', step  2 and misstep 3: ' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' 2) b' || chr(10) || '3. c STEP 4' || chr(10) || '5.d' ELSE '' END"""


@query("i07_steps", f"WITH r AS (SELECT doc_id, {_STEPS} AS t FROM documents), n AS (SELECT doc_id, greatest(len(regexp_extract_all(t, '(?:^|\\n)\\s*\\d+[.\\)]\\s')), len(regexp_extract_all(t, '(?i)\\bstep\\s+\\d+'))) AS n FROM r) SELECT doc_id, n AS n_steps, (n >= 2)::INT AS has_steps FROM n")
def i07(spark, sf):
    return _made(spark, sf, "documents", made=_STEPS).select("doc_id", *[c.alias(k) for k, c in X.step_count(F.col("made")).items()])


@query("i13_i15_arithmetic", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE -1 END, 9) AS ratio, round(ln(1 + l_quantity), 9) AS log1p, round(log2(l_quantity + 1), 9) AS log2, round_even(l_quantity / 4, 0) AS half_even, greatest(5, least(l_quantity, 40)) AS clipped FROM lineitem")
def i13(spark, sf):
    from threadloom.functions.scalar import clip, finite, safe_div

    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(safe_div(F.col("l_tax"), F.col("l_discount"), -1), 9).alias("ratio"), F.round(F.log1p(finite(F.col("l_quantity"))), 9).alias("log1p"),
        F.round(F.log2(F.col("l_quantity") + 1), 9).alias("log2"), F.bround(F.col("l_quantity") / 4, 0).alias("half_even"), clip(F.col("l_quantity"), F.lit(5.0), F.lit(40.0)).alias("clipped"),
    )


_LINKS = "coalesce(text, '') || repeat(' [LINK]', CAST(doc_id % 4 AS INT)) || CASE WHEN doc_id % 3 = 0 THEN ' [POLICY] x [WIKILINK]' ELSE ' [QUOTE]' END || repeat('[HELP_PAGE]', CAST(doc_id % 2 AS INT))"


@query("i16_resources", f"WITH r AS (SELECT doc_id, text, {_LINKS} AS l FROM documents) SELECT doc_id, len(regexp_extract_all(l, '\\[(?:LINK|POLICY|WIKILINK|HELP_PAGE)\\]')) AS n_resources, round(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) / 4, 6) AS word_ratio FROM r")
def i16(spark, sf):
    d = _made(spark, sf, "documents", links=_LINKS)
    return d.select("doc_id", X.resource_count(F.col("links")).alias("n_resources"), F.round(F.size(X.words(F.coalesce("text", F.lit("")))) / 4, 6).alias("word_ratio"))


@query("i17_e40_stars", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END AS stars, CASE WHEN l_discount - 0.02 > 0 OR l_tax - 0.04 < 0 THEN '*' ELSE '' END AS sig FROM lineitem")
def i17(spark, sf):
    from threadloom.functions.scalar import stars
    from threadloom.operators.stats import significant

    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", stars(F.col("l_discount")).alias("stars"), significant(F.col("l_discount") - 0.02, F.col("l_tax") - 0.04).alias("sig"))


@query("html_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"[^\"]*\"'))::BIGINT AS n_links, len(regexp_extract_all(html, '<!--'))::BIGINT AS n_comments FROM pages")
def html(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit('<a href="[^"]*"')).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<!--")).cast("long").alias("n_comments"))
