"""Tables that are kept by key."""

import os

import pytest

from lanternflow.operators import chats as C
from lanternflow.operators import tables as B

from test_operators import rows


def test_last_change_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "e", 3), (2, "d", 2), (3, "x", 1), (None, "m", 1), (2, "z", None)], "k long, v string, at long")
    got = [tuple(r) for r in B.upsert(old, new, ["k"], ["at"]).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a"), (2, "e"), (3, "x"), (None, "m")], key=repr)
    assert B.upsert(old, new.drop("at"), ["k"]).count() == 4
    wide = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k long, v string, w string")
    changes = spark.createDataFrame([(1, "b", None, 1), (1, None, "r", 2), (1, "c", None, 3), (9, "x", "y", 1)], "k long, v string, w string, at long")
    assert rows(B.partial_update(wide, changes, ["k"], ["at"])) == [(1, "c", "r"), (2, "b", "q")]
    chats = spark.createDataFrame([(1, 7, "t")], "id long, user_id long, title string")
    renamed = C.rename(chats, spark.createDataFrame([(1, 7, "one", 1), (1, 7, "two", 3), (1, 7, " ", 4), (1, 8, "no", 5)], "id long, user_id long, new_title string, at long"), ["at"])
    assert rows(renamed, "id", "title") == [(1, "two")]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_parts_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = B.KeyedTable(spark, f"file://{path}", "k bigint, v string", ["k"], 16)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(k, "a") for k in range(400)], "k long, v string"))
    before = files(path)
    assert len(table.upsert(spark.createDataFrame([(5, "b", 1), (5, "c", 2), (1000, "n", 1)], "k long, v string, at long"), ["at"])) <= 2
    after = files(path)
    assert len(before.keys() & after.keys()) >= 14 and all(before[f] == after[f] for f in before.keys() & after.keys())
    assert table.read().count() == 401 and rows(table.read().filter("k = 5")) == [(5, "c")]
    table.update(spark.createDataFrame([(6, "u"), (7777, "x")], "k long, v string"))
    table.delete(spark.createDataFrame([(8,), (9,)], "k long"))
    again = B.KeyedTable(spark, f"file://{path}", "k bigint, v string", ["k"], 16)
    assert again.read().count() == 399 and rows(again.read().filter("k in (6, 8)")) == [(6, "u")]
    with pytest.raises(ValueError):
        table.change(spark.createDataFrame([(5,)], "k long"), lambda held: held.union(held))
    assert rows(table.read().filter("k = 5")) == [(5, "c")]  # nothing was written
    assert table.upsert(spark.createDataFrame([], "k long, v string")) == []
    lone = B.KeyedTable(spark, f"file://{tmp_path}/u", "k bigint, v string", ["k"], 4)
    lone.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    lone.delete(spark.createDataFrame([(1,)], "k long"))
    assert lone.read().count() == 0
