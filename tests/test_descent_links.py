"""Which rows a round of the descent looks around."""

from themeloom.operators import descent


def test_rows_without_fresh_links_are_left_out(spark):
    rows = [(1, 2, 0.1, 1, False), (2, 1, 0.1, 1, False), (3, 4, 0.2, 1, True), (4, 3, 0.2, 1, False), (3, 5, 0.3, 2, False)]
    lists = spark.createDataFrame(rows, "src long, dst long, dist double, rank int, fresh boolean")
    found = {(r["mid"], r["other"], r["fresh"]) for r in descent._around(lists, 2).collect()}
    assert found == {(3, 4, True), (3, 5, False), (4, 3, True)}
