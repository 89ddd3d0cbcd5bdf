import pytest

from terrasift.plans import registry
from tests.oracle import compare

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, name):
    assert compare(spark, sf, registry.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_short_quotations_are_found(spark, tmp_path):
    texts = ["It was there, he said.", "two words", "one", None, "", "a much longer text in which the SHORT quotation stands with it was there"]
    quotes = ["was there", "two words", "ONE", "the short quotation stands", "text in which the short quotation stands with", "nowhere", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "b"))
    for short, name in (("d", "documents"), ("b", "benchmark")):
        next((tmp_path / short).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    f = registry.queries()["quotes_restored"]
    assert compare(spark, str(tmp_path), f, SQL["quotes_restored"]) == ""
    assert sorted(map(tuple, f(spark, str(tmp_path)).collect())) == [(0, 0), (1, 1), (2, 2), (5, 0), (5, 3), (5, 4)]
