"""Queries that pair rows or score paths, on larger tables than the others."""

import pytest

from helixframe import registry
from tests.compare import database, differences

SF = "/root/testdata/sf0.01"
NAMES = ("near_profiles", "marker_clusters", "breakpoint_calls", "region_reads", "nested_rollup", "shared_lineage_depth", "hom_ref_fill", "pairwise_distance", "nearest_members", "cluster_components", "fuzzy_kit_match", "force_call_sites", "identity_checks", "callset_outcomes", "tree_score", "multiallelic_genotypes", "str_diploid_call")


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql_on_larger_tables(spark, db, name):
    assert differences(spark, db, name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def test_hom_ref_fill_sees_all_orders(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(7, 1, 2, 50.0, 0.09), (51, 2, 4, 50.0, 0.09), (8, 2, 1, 50.0, 0.09), (9, 3, 6, 50.0, 0.09), (9, 4, 2, 48.0, 0.09), (9, 4, 3, 50.0, 0.01)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["hom_ref_fill"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (2, 1), (4, 0)]
