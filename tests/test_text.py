"""Text functions and markup on rows made for their branches."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import wikitext as M

TIME = "10:00, 3 March 2024 (UTC)"


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("c")).first().c


def many(spark, columns, text):
    return spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_features_of_a_message(spark):
    f = many(spark, X.text_features(F.col("t"), "q"), "Hi there! I'm new. How do I undo this? Thanks [POLICY] [LINK] [LINK]\n1. x")
    assert f["q_words"] == 15 and f["q_has_greeting"] == f["q_has_thanks"] == f["q_has_self_intro"] == f["q_mentions_revert"] == f["q_has_list"] == 1
    assert (f["q_n_policy"], f["q_n_link"], f["q_n_question_marks"], f["q_n_exclamation"]) == (1, 2, 1, 1)
    assert f["q_sentences"] == 4 and f["q_is_single_sentence"] == 0 and f["q_n_paragraphs"] == 1


@pytest.mark.parametrize("text", ["", None])
def test_features_of_nothing_are_zero(spark, text):
    for columns in (X.text_features(F.col("t"), "q"), X.politeness(F.col("t")), X.readability(F.col("t")), X.wiki_features(F.col("t")), X.pronoun_counts(F.col("t"))):
        assert set(many(spark, columns, text).values()) == {0}


def test_stems_do_not_match_inflected_words(spark):
    f = many(spark, X.text_features(F.col("t"), "q"), "deleted notability protected plagiarism gng")
    assert not any(f[f"q_mentions_{k}"] for k in ("deletion", "notability", "protection", "copyright"))
    assert many(spark, X.text_features(F.col("t"), "q"), "semi-protect the draft")["q_mentions_protection"] == 1


@pytest.mark.parametrize(("text", "n"), [("", 0), ("  \n", 0), ("no mark", 1), ("One. Two!", 2), ("Wait... what?! Yes", 2), ("a. b. ", 2)])
def test_sentence_count(spark, text, n):
    assert one(spark, X.sentence_count(F.col("t")), t=text) == n


@pytest.mark.parametrize(("word", "n"), [("a", 1), ("be", 1), ("cake", 1), ("table", 1), ("banana", 3), ("rhythm", 1), ("the", 1), ("Idea", 2), ("tsk", 1)])
def test_syllables(spark, word, n):
    assert one(spark, X.syllables(F.col("t")), t=word) == n


def test_steps_and_pronouns(spark):
    assert many(spark, X.step_count(F.col("t")), "1. a\n2) b\nStep 3 step 4 step 5") == {"n_steps": 3, "has_steps": 1}
    assert many(spark, X.step_count(F.col("t")), "step 1") == {"n_steps": 1, "has_steps": 0}
    assert many(spark, X.pronoun_counts(F.col("t")), "You and I, your's, our we us me") == {"n_you": 1, "n_i": 2, "n_we": 3}


@pytest.mark.parametrize(("text", "english"), [("", True), ("é", True), ("12 34!", True), ("aaaaaaaaéé", True), ("aaaaaaaéé", False), ("привет мир", False)])
def test_is_english(spark, text, english):
    assert one(spark, X.is_english(F.col("t")), t=text) is english


def test_politeness(spark):
    f = many(spark, X.politeness(F.col("t")), " Please, could you help? I think it is great. Sorry")
    assert {k for k, v in f.items() if v} == {f"polite_{k}" for k in ("please", "please_start", "hedges_think", "deference", "apologizing", "1st_person", "2nd_person", "direct_question", "has_positive", "subjunctive")}


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Hello [[User:A B|A]] ([[User talk:A B|talk]]) " + TIME, "Hello"),
        ("a​b {{tq|said}} {{tl|x}} {{done}} {{cite web|u}} {{reflist}}z", "ab [QUOTE] said [/QUOTE] [TEMPLATE_REF] [STATUS] [CITATION] z"),
        ("{{" + "x" * 210 + "}}", "[TEMPLATE]"),
        ("[[File:X.png|thumb]]see [[WP:N|n]] [[wp:RS]]", "see [POLICY]"),
        ("[[Help:B]] [[Draft:C|c]] [[Category:D|shown]] [[Category:E]]", "[HELP_PAGE] [DRAFT] shown"),
        ("[[:fr:Page]] [[Some article|text]] [https://a.b c] http://x.y", "[WIKILINK] [LINK]"),
        (":: indented\n\n* listed\n:) smile", "indented\nlisted\n:) smile"),
        ("<b>bold</b> '''x''' &nbsp; <!-- gone\nall -->end", "bold x end"),
        ("", ""),
    ],
)
def test_clean_wikitext(spark, raw, clean):
    assert one(spark, M.clean_wikitext(F.col("t")), t=raw) == clean


def test_embedding_text_quotes_names(spark):
    c = M.embedding_text(F.col("t"), F.col("a"), F.col("b"))
    assert one(spark, c, t="Hi @New(user)+_1, call 0123-456-789 now . Signed,", a="New(user)+_1", b="M\\E.x") == "Hi, call now."
    assert one(spark, c, t="Thanks Mentor One", a=None, b="Mentor_One") == "Thanks"


def test_signatures(spark):
    raw = "Hi [[User:M One|m]] " + TIME + "\n: x [[User talk:O_ther#a|o]] 11:00, 4 Foo 2024 (UTC)" + "y" * 600 + TIME
    sigs = M.signatures(F.col("t"))
    got = one(spark, sigs, t=raw)
    assert [(s.signer, s.ts) for s in got] == [("m one", "2024-03-03T10:00:00Z"), ("o ther", None)]
    assert raw[: got[0].end].endswith("(UTC)")
    assert one(spark, M.truncate_reply(F.col("t"), sigs, F.lit("M_One")), t=raw) == raw[: got[0].end]
    assert one(spark, M.reply_time(F.col("t"), sigs, F.lit("nobody")), t=raw) == "2024-03-03T10:00:00Z"
    assert one(spark, M.signers(sigs), t=raw) == ["m one", "o ther"]
    assert one(spark, sigs, t="") == []


def test_questions(spark):
    wt = f"x\n== Question from [[User:N_1|N]] on [[P q]] (09:05, 7 July 2025) ==\nbody\n=== sub ===\nmore\n== Next ==\nz\n== Question from [[User:B]] (1:05, 8 July 2025) ==\nlast"
    got = one(spark, M.questions(F.col("t")), t=wt)
    assert [(q.mentee, q.article, q.asked, q.body) for q in got] == [("N_1", "P q", "09:05, 7 July 2025", "body\n=== sub ===\nmore"), ("B", None, "1:05, 8 July 2025", "last")]
    assert one(spark, M.find_section(M.questions(F.col("t")), F.lit("n_1")), t=wt).mentee == "N_1"
    assert one(spark, M.find_section(M.questions(F.col("t")), F.lit("zz")), t=wt).mentee == "B"


def test_split_and_trim_replies(spark):
    body = ": [[User talk:M]] is away\nq1\nq2\n*: r1\nr2"
    assert many(spark, M.split_reply(F.col("t")), body) == {"question": "q1\nq2", "reply": "*: r1\nr2"}
    assert many(spark, M.split_reply(F.col("t")), "only") == {"question": "only", "reply": None}
    assert one(spark, M.reply_only(F.col("q"), F.col("r")), q="a\nb", r="a \nb\nc") == "c"
    assert one(spark, M.reply_only(F.col("q"), F.col("r")), q="a\nb", r="a\nb") is None
    assert one(spark, M.reply_only(F.col("q"), F.col("r")), q="a", r="x\na") == "x\na"
    long = "q" * 50
    assert one(spark, M.fixed_reply(F.col("q"), F.col("r")), q=long, r=long + " more") is None
    assert one(spark, M.fixed_reply(F.col("q"), F.col("r")), q="q" * 49, r="q" * 49 + " more") == "q" * 49 + " more"


def test_json_answers(spark):
    labels = M.json_labels(F.col("t"), ["Q0", "Q2"])
    assert many(spark, labels, '```json\n{"Q0": "Y", "Q2": "N"}```') == {"Q0": "Y", "Q2": "N"}
    assert many(spark, labels, '{"Q0": "Y"} "Q2": "N"') == {"Q0": "Y", "Q2": "N"}
    assert many(spark, labels, '{"Q0": "Y", "Q2": "?"}') == {"Q0": None, "Q2": None}


def test_mentor_lists(spark):
    got = one(spark, M.mentor_rows(F.col("t")), t="* [[User:Ann A|Ann]] - hi\n*[[user:Bob_B]]\nno [[User:C]]\n")
    assert [(m.username, m.message) for m in got] == [("Ann A", "hi"), ("Bob_B", "")]
    got = one(spark, M.json_mentors(F.col("t")), t='{"Mentors":{"11":{"username":"Ann","weight":2,"automaticallyAssigned":true}}}')
    assert got["11"].username == "Ann" and got["11"].weight == 2
    assert one(spark, M.json_mentors(F.col("t")), t="{bad") == {}
