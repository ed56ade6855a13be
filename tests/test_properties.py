"""Properties of functions over generated rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import wikitext as M
from threadloom.operators import stats as S

RULES = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=20)


@RULES
@given(TEXTS)
def test_words_equal_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.words(F.col("t")).alias("w"), X.count_of(F.col("t"), "a").alias("n")).collect()
    for r in rows:
        # Separators U+001C to U+001F count as white space in one language only.
        if not set(texts[r.i]) & set("\x1c\x1d\x1e\x1f"):
            assert r.w == texts[r.i].split()
        assert r.n == texts[r.i].count("a")


@RULES
@given(TEXTS)
def test_cleaning_is_stable_on_plain_lines(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(M.clean_wikitext(F.col("t")).alias("c")).collect()
    assert all("[[" not in r.c or "]]" not in r.c.split("[[", 1)[1] for r in rows)


@RULES
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=80), st.integers(2, 8))
def test_bins_are_ordered(spark, values, k):
    rows = S.qcut(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", k, "b").orderBy("x").collect()
    bins = [r.b for r in rows]
    if len(set(values)) == 1:
        assert set(bins) == {None}
    else:
        assert bins == sorted(bins) and bins[0] == 0 and bins[-1] < k
