"""Every registered query with SQL gives the SQL's rows; the others give rows, the same ones twice."""

import os

import pytest

from oracle import DATA, connection, rows_of_spark, rows_of_sql
from threadloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert rows_of_spark(QUERIES[name](spark, DATA)) == rows_of_sql(duck, SQL[name])


@pytest.mark.parametrize("name", ["e39_cluster_bootstrap", "j05_ablation", "j08_anchor_sampled", "j14_mixed_model", "j21_direction", "m03_moderation_intervals"])
def test_repeats_itself(spark, name):
    first, again = rows_of_spark(QUERIES[name](spark, DATA)), rows_of_spark(QUERIES[name](spark, DATA))
    assert first == again and first[1]


def test_sql_has_queries():
    assert not set(SQL) - set(QUERIES)
