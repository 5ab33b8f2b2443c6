"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pytest

from recolith.oracle import compare, connect
from recolith.plans import registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, con, name):
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["scan_inventory", "scan_probe_plan", "scan_roots_first_wins"])
def test_tables_in_parts(spark, tmp_path, name):
    """Scans of tables of which some are folders of parts."""
    for f in os.listdir(SF):
        if f[0] in "deln":
            (tmp_path / f).mkdir()
            for i in range(2):
                os.symlink(f"{SF}/{f}", tmp_path / f / f"part-{i}.parquet")
        else:
            os.symlink(f"{SF}/{f}", tmp_path / f)
    d = str(tmp_path)
    assert compare(spark, connect(SF), registry.QUERIES[name], registry.ORACLE_SQL[name], d) == ""


@pytest.mark.parametrize("name", ["scan_inventory", "scan_probe_plan", "scan_roots_first_wins"])
def test_copies_below_are_no_tables(spark, tmp_path, name):
    """Tables with copies in folders below, one of them hidden from Spark's listing."""
    for at, names in (("", os.listdir(SF)), ("old", ["nation.parquet", "orders.parquet"]), ("_kept", ["lineitem.parquet", "part.parquet"])):
        (tmp_path / at).mkdir(exist_ok=True)
        for f in names:
            os.symlink(f"{SF}/{f}", tmp_path / at / f)
    assert compare(spark, connect(SF), registry.QUERIES[name], registry.ORACLE_SQL[name], str(tmp_path)) == ""
