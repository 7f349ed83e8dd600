"""Every query of the engine gives the rows of its SQL."""

from __future__ import annotations

import pytest

from kmerlake.plans import catalogue, files, names, registry  # noqa: F401
from tests.conftest import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == rows_of_sql(duck, registry.SQL[name])


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.SQL.keys()


def test_lists_and_maps_read_whole_tables(spark, tmp_path):
    """Seven regions, and items without one: no fixed subset of the items; every order is in the GI map."""
    from kmerlake.plans import names

    spark.range(9).selectExpr("id as item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(7).selectExpr("cast(id as int) as r_regionkey", "concat('r', id) as r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(10).selectExpr("id as o_orderkey", "id + 50 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    out = names.file_group_zip(spark, str(tmp_path)).collect()
    assert sorted((r["pos"], r["file"], r["group"]) for r in out) == [(i, f"file{i}", f"r{i}") for i in range(7)]
    gis = {r["tax_id"]: r["gi"] for r in names.gi_map(spark, str(tmp_path)).collect()}
    assert len(gis) == 10 and all(g == c - 50 if (c - 50) % 3 else g < 0 for c, g in gis.items())
