"""What must not grow faster than the facts: work done once a change."""

from __future__ import annotations

from surfacelens.operators import diff
from surfacelens.sources import fixtures

SCHEMA = "snapshot_id string, kind string, key string, name string, path string, line int, attrs map<string,string>"


def test_deltas_are_written_with_the_joined_rows(spark):
    pairs = fixtures.pairs(spark)
    rows = [("v1", "pref", "p", "p", "a/b.cc", 1, {"var": '"kA"'}), ("v2", "pref", "p", "p", "a/b.cc", 2, {"var": '"kB"'}), ("v1", "pref", "q", "q", "a/b.cc", 3, {}), ("v2", "pref", "q", "q", "a/b.cc", 4, {})]
    moved = diff._moved(spark.createDataFrame(rows, SCHEMA), pairs, True)
    assert [(r.key, r.change_type, [tuple(d) for d in r.deltas]) for r in moved.collect()] == [("p", "modified", [("var", '"kA"', '"kB"')])]
