import __spark_entry__ as entry
from feedmill.plans import catalog


def test_contract(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 100
    own = {name for name in queries if name in catalog.load()}
    assert own - set(sql) == {"text_search"}
