from __future__ import annotations

import hashlib
import os
from collections import defaultdict

from kmerlake.llm import exact_dedup, queries
from kmerlake.llm.common import drop_staged, staged
from kmerlake.llm.exact_dedup import DigestIndex, drop_copies
from tests.conftest import rows_of, rows_of_sql
from tests.llm.data import documents, edge_rows, frame

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows):
    groups = defaultdict(list)
    for key, text, *_ in rows:
        groups[(text or "").translate(UP)].append(key)
    out = []
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        out += [(k, keep, len(keys), k == keep, hashlib.sha256(text.encode()).digest()) for k in keys]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]))) for r in df.collect())


def test_brute_force(spark):
    rows = documents() + edge_rows()
    assert got(DigestIndex.at(spark).add(frame(spark, rows, True))) == brute(rows)


def test_empty_table(spark):
    index = DigestIndex.at(spark)
    assert index.add(frame(spark, [])).collect() == []
    assert index.add(frame(spark, documents()[:5])).count() == 5


def test_index_persists(spark):
    """A second batch loses what an earlier one had, also through an index that is attached again."""
    index = DigestIndex.at(spark, buckets=8)
    index.add(frame(spark, [(1, "a b", "", "", 0), (2, "c", "", "", 0)]))
    index.close()
    again = DigestIndex.at(spark, index.path)
    assert again.buckets == 8
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in again.add(frame(spark, [(9, "A B", "", "", 0), (8, "new", "", "", 0), (7, "NEW", "", "", 0)])).collect()}
    assert out == {9: (1, 2, False), 8: (8, 2, True), 7: (8, 2, False)}
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [1, 2, 8]


def labels_of(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_a_batch_that_comes_again_is_labelled_as_before(spark):
    index = DigestIndex.at(spark, buckets=4)
    one, two = frame(spark, [(1, "a", "", "", 0), (2, "b", "", "", 0)]), frame(spark, [(5, "A", "", "", 0), (6, "c", "", "", 0)])
    first, second = labels_of(index.add(one, batch="one")), labels_of(index.add(two, batch="two"))
    assert first == [(1, 1, 1, True), (2, 2, 1, True)] and second == [(5, 1, 2, False), (6, 6, 1, True)]
    again = DigestIndex.at(spark, index.path)
    assert labels_of(again.add(one, batch="one")) == first and labels_of(again.add(two, batch="two")) == second
    assert again.rows().count() == 3
    assert sorted(r["doc_id"] for r in drop_copies(one, again, batch="one").collect()) == [1, 2]


def test_an_append_that_breaks_off_does_not_count(spark, monkeypatch):
    index = DigestIndex.at(spark, buckets=4)
    rows = frame(spark, [(1, "a", "", "", 0)])
    with monkeypatch.context() as m:
        m.setattr(DigestIndex, "_publish", lambda *x: 1 / 0)
        try:
            index.add(rows, batch="b")
        except ZeroDivisionError:
            pass
    again = DigestIndex.at(spark, index.path, 4)
    assert again.rows().count() == 0 and labels_of(again.add(rows, batch="b")) == [(1, 1, 1, True)]


def test_many_batches_are_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MERGE", 2)
    index = DigestIndex.at(spark, buckets=2)
    for i in range(5):
        index.add(frame(spark, [(10 * i, f"t{i}", "", "", 0), (10 * i + 1, "same", "", "", 0)]), batch=str(i))
    assert len(index.tables) <= 2 and index.rows().count() == 6
    assert labels_of(DigestIndex.at(spark, index.path).add(frame(spark, [(20, "t2", "", "", 0), (21, "same", "", "", 0)]), batch="2")) == [(20, 20, 1, True), (21, 1, 2, False)]


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PER_BUCKET", 2)
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 2)
    index = DigestIndex.at(spark)
    index.add(frame(spark, documents()))
    assert index.buckets == 32


def test_join_with_the_index_moves_and_sorts_nothing(spark):
    index = DigestIndex.at(spark, buckets=4)
    index.append(frame(spark, documents()))
    new = index.append(frame(spark, documents(2)))
    old = index._table(index.tables[0])
    plan = spark.table(new.groups).join(old.hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "+- Sort " not in plan and "Sort [" not in plan


def test_nothing_is_left_in_the_catalog(spark):
    index = DigestIndex.at(spark)
    out = index.add(frame(spark, documents()))
    index.drop()
    assert out.count() == len(documents()) and not os.path.exists(index.path.removeprefix("file://"))
    assert not [t.name for t in spark.catalog.listTables() if index._name(index.tables[0]) == t.name]


def test_hot_group(spark):
    """A third of all rows have one text."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", "", "", 0) for i in range(3000)]
    out = DigestIndex.at(spark).add(frame(spark, rows)).filter("group_size > 1").collect()
    assert len(out) == 1000 and {(r["keep_id"], r["group_size"]) for r in out} == {(2997, 1000)}


def test_drop_copies_keeps_columns_and_keyless_rows(spark):
    df = frame(spark, documents() + edge_rows(), True)
    out = drop_copies(df, DigestIndex.at(spark))
    assert out.columns == df.columns
    kept = {r["doc_id"] for r in DigestIndex.at(spark).add(df).collect() if r["kept"]}
    assert {r["doc_id"] for r in out.collect()} - {None} == kept - {None}
    assert out.filter("doc_id is null").count() == 2


def test_staged_tables_can_be_dropped(spark):
    df = staged(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    assert drop_staged(spark) >= 1 and not os.path.isdir(path)


def test_sql(spark, duck):
    for name in queries.SQL:
        assert rows_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001")) == rows_of_sql(duck, queries.SQL[name])
