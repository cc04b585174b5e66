"""Corpus queries against their SQL, and all of them on the smallest tables."""

import pytest

from peakforge.llm.oracles import ORACLES
from peakforge.llm.queries import QUERIES

from ..compare import DATA, check

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", ["op1_url_markov_ratio", "op2_page_differencing"])
def test_a_row_per_page(spark, name):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    out = QUERIES[name](spark, str(DATA))
    assert out.count() == pages.count() and out.select("page_id").distinct().count() == pages.count()


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
