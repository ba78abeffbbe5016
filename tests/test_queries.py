"""Every registered query beside its SQL, and the plans of some."""

import re

import check
import pytest

import __spark_entry__ as entry_points
from tracewell.plans import ORACLES as SQL
from tracewell.plans import QUERIES
from tracewell.session import shared_dir, work_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, connection, name):
    if name.startswith(("src04", "src05", "src06")):
        pytest.importorskip("yaml")
    assert check.compare(spark, connection, SMALL, name, QUERIES[name], SQL.get(name)) is None


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).where("matched").count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_product(spark):
    skip = ("src0", "snk", "ss0")
    for name, function in QUERIES.items():
        if not name.startswith(skip):
            text = plan(function(spark, SMALL))
            assert "CartesianProduct" not in text, name
            # Few markers against whole texts is the one join without a key.
            nested = "BroadcastNestedLoopJoin" in text
            assert not nested or name in ("jn04_content_iocs", "jn05_detect_iocs", "ag05_findings_document"), name


def test_scans_read_only_what_they_need(spark):
    schemas = lambda name: re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SMALL)))
    assert all("text" not in s for s in schemas("snk03_ground_truth") if "doc" in s)
    assert set(schemas("jn13_ready_within")) == {
        "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string",
        "ts:timestamp_ntz,user_id:bigint,event_type:string",
    }
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan(QUERIES["jn13_ready_within"](spark, SMALL)))
    assert all("EqualTo(event_type" in p for p in pushed)


def test_shared_folder(spark):
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        assert shared_dir(spark) == set_to.rstrip("/")
    assert work_path(spark, "x") != work_path(spark, "x")
    assert work_path(spark, "x").startswith(shared_dir(spark))
