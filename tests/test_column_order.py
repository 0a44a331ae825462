"""Columns keep the order of the panel, whether series are named by a list or by a table."""

from tidepanel.operators import transform


def test_tables_of_names_keep_the_order(spark, make_panel):
    panel = make_panel({"a": [1.0, 2.0], "b": [4.0, None], "index": [50.0, 200.0]})
    table = spark.createDataFrame([("a",), ("b",)], "series_id string")
    for names in (["a", "b"], table, table.limit(0)):
        assert transform.log_transform(panel, names).columns == panel.columns
        assert transform.deflate(panel, "index", names).columns == panel.columns
    assert transform.deflate(panel, "index", table.limit(0)).exceptAll(panel).count() == 0
    got = {(r["series_id"], r["value"]) for r in transform.deflate(panel, "index", table).collect()}
    assert got == {("a", 2.0), ("a", 1.0), ("b", 8.0), ("b", None), ("index", 50.0), ("index", 200.0)}
