"""The shared folder with and without the setting that names it."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from kmerlake import shared


def session(master, path=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: path or default), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}-{path}"))


def test_folder_by_setting_and_without():
    assert shared.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("spark://host:7077"))
    one = session("local[4]")
    assert shared.shared_dir(one).startswith("file:///") and shared.shared_dir(one) == shared.shared_dir(one)


def test_staged_tables_go_but_for_those_still_read(spark):
    mark = shared.staged_so_far()
    first = shared.staged(spark.range(5).toDF("x"), "first")
    second = shared.staged(first.selectExpr("x + 1 as x"), "second")
    assert shared.drop_staged(spark, mark, (second,)) == 1
    assert sorted(r["x"] for r in second.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="(?i)not exist|not found|does not"):
        first.collect()
    assert shared.drop_staged(spark, mark) == 1
