import pytest
from conftest import rows

from tracewell.operators import integrity as ig


def test_verify_checksums(spark):
    images = spark.createDataFrame(
        [(i, "l", f, d) for i, (f, d) in enumerate(
            [("a", "h1"), ("a", "h2"), ("b", "h3"), ("c", None), ("z", None)])],
        "image_id int, list_id string, file_name string, digest string",
    )
    lines = spark.createDataFrame(
        [("l", 3, "h9", "a"), ("l", 1, "h1", "a"), ("l", 2, "h5", "c"), ("m", 0, "h3", "b")],
        "list_id string, line_no int, hash string, file_name string",
    )
    for limit in (1, 1000):
        assert rows(ig.verify_checksums(images, lines, limit), "image_id", "status") == [
            (0, "ok"), (1, "mismatch"), (2, "not_listed"), (3, "absent"), (4, "absent")
        ]


def test_symbols(spark):
    symbols = spark.createDataFrame(
        [("ubuntu", "ubuntu_5.15.0-91-generic.json"), ("ubuntu", "ubuntu_5.15.0-101-generic.json")],
        "family string, file_name string",
    )
    distros = spark.createDataFrame(
        [("ubuntu-22.04",), ("ubuntu-24.04",), ("debian-13",)], "distro_id string"
    )
    for broadcast_rows in (0, 10):
        assert rows(ig.resolve_symbols(distros, symbols, broadcast_rows, 1), "distro_id", "file_name") == [
            ("ubuntu-22.04", "ubuntu_5.15.0-91-generic.json"),
            ("ubuntu-24.04", "ubuntu_5.15.0-91-generic.json"),
        ]
    assert rows(ig.missing_symbols(distros, symbols, 1), "distro_id") == [("debian-13",)]


@pytest.mark.parametrize("broadcast_rows", [0, 10])
def test_select_tests(spark, broadcast_rows):
    registry = spark.createDataFrame(
        [("one", "T1", "g2"), ("every", "T1", ""), ("null", "T2", None), ("wrong", "T2", "g1")],
        "key string, technique_id string, test_guid string",
    )
    catalog = spark.createDataFrame(
        [("T1", "g1"), ("T1", "g2"), ("T2", "g3")], "technique_id string, guid string"
    )
    assert rows(ig.select_tests(registry, catalog, broadcast_rows, 1), "key", "guid") == [
        ("every", "g1"), ("every", "g2"), ("null", "g3"), ("one", "g2")
    ]


@pytest.mark.parametrize("broadcast_rows", [0, 10])
def test_validate_registry(spark, broadcast_rows):
    requests = spark.createDataFrame(
        [(1, "d", "good"), (2, "x", "good"), (3, "d", "nope"), (4, "d", "bad"), (5, "x", "nope")],
        "request_id int, distro_id string, key string",
    )
    registry = spark.createDataFrame([("good", "T1"), ("bad", None)], "key string, technique_id string")
    profiles = spark.createDataFrame([("d",), ("d",)], "distro_id string")
    got = ig.validate_registry(requests, registry, profiles, broadcast_rows, 1)
    assert rows(got, "request_id", "reason") == [
        (1, "ok"), (2, "no_profile"), (3, "unknown_scenario"), (4, "no_technique"), (5, "no_profile")
    ]


def test_first_match_keeps_one_row_per_task(spark):
    df = spark.createDataFrame([("k", i, i % 5) for i in range(50)], "key string, n int, v int")
    best = ig.first_match(df.repartition(4), ["key"], ["v", "n"])
    assert rows(best, "n") == [(0,)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_duplicate_keys_stay_rows(spark):
    df = spark.createDataFrame([("hot", i) for i in range(20)] + [("x", 1), ("y", 2), ("y", 3)], "k string, m int")
    got = rows(ig.duplicate_keys(df, "k", "m", 5))
    assert got == sorted([("hot", 20, i) for i in range(20)] + [("y", 2, 2), ("y", 2, 3)], key=lambda r: tuple((False, str(v)) for v in r))
