import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import ioc
from tracewell.operators.metrics import findings_document, outcome_metrics

KEYS = "/home/u/.ssh/authorized_keys"


def entries_of(spark, data):
    return spark.createDataFrame(
        data, "run_id string, path string, size_bytes bigint, content string, source string"
    )


def expected_of(spark, data):
    """Indicators from (run, id, type, attributes, sources)."""
    full = []
    for n, (run, id_, kind, attributes, sources) in enumerate(data):
        a = dict(attributes)
        known = [a.pop(k, None) for k in ("path", "content_contains", "exists", "size_bytes", "plugin")]
        full.append((run, "s", n, id_, kind, *known, a, sources))
    return spark.createDataFrame(full, schemas.EXPECTED_IOC)


KEY_FILE = ("key", "file", {"path": KEYS, "content_contains": "marker"}, ["list", "stat"])
LOG = ("log", "file", {"path": "/var/log/auth.log", "size_bytes": 0}, ["stat"])
GONE = ("gone", "file", {"path": "/root/.history", "exists": False}, ["list"])
ANY = ("any", "file", {"content_contains": "two words and more"}, None)
REGISTRY = ("reg", "registry", {"path": KEYS}, None)
ALL = (KEY_FILE, LOG, GONE, ANY, REGISTRY)


@pytest.mark.parametrize(
    "entries, matched",
    [
        ([("r", KEYS, 9, "a marker b", "list")], {"key", "gone"}),
        ([("r", KEYS, 9, "other", "list")], {"gone"}),
        ([("r", KEYS, 9, None, "list")], {"gone"}),
        ([("r", "/var/log/auth.log", 0, None, "stat")], {"log"}),
        ([("r", "/var/log/auth.log", 10, None, "stat")], set()),
        ([("r", "/var/log/auth.log", None, None, "stat")], set()),
        ([("r", "/root/.history", 0, None, "list")], set()),
        ([("r", "/root/.history", 0, None, "stat")], set()),
        ([("r", "/x", 1, "xtwo words and morex", "stat")], {"any"}),
        ([("other", KEYS, 9, "marker", "list")], set()),
        ([], set()),
    ],
)
def test_findings(spark, entries, matched):
    expected = expected_of(spark, [("r", *i) for i in ALL])
    for copies in (1, 3):
        evidence = ioc.Evidence(entries=entries_of(spark, entries * copies))
        findings = ioc.detect_iocs(expected, evidence)
        got = findings.collect()
        assert len(got) == len(ALL)
        assert {f.ioc_id for f in got if f.matched} == matched


def test_absence_needs_a_look(spark):
    expected = expected_of(
        spark, [(r, *GONE) for r in ("seen", "other", "none")] + [("seen", "free", "file", {"path": "/y", "exists": False}, None)]
    )
    entries = entries_of(spark, [("seen", "/x", 1, None, "list"), ("other", "/x", 1, None, "stat")])
    for limits in (ioc.Limits(), ioc.Limits(64, 0, 1)):
        got = ioc.match_absent_iocs(entries, expected, limits=limits)
        assert rows(got, "run_id", "ioc_id", "assessed", "matched") == [
            ("none", "gone", False, False),
            ("other", "gone", False, False),
            ("seen", "free", True, True),
            ("seen", "gone", True, True),
        ]


def test_findings_are_runs_times_indicators(spark):
    runs = [f"r{i}" for i in range(5)]
    expected = expected_of(spark, [(r, *i) for r in runs for i in ALL])
    entries = entries_of(spark, [(r, KEYS, 1, "marker", "list") for r in runs[:2]])
    for parts in (1, 7):
        evidence = ioc.Evidence(entries=entries.repartition(parts))
        findings = ioc.detect_iocs(expected.repartition(parts), evidence)
        assert findings.count() == len(runs) * len(ALL)
        assert findings.where("matched AND ioc_id = 'key'").count() == 2
    documents = findings_document(findings)
    first = documents.where("run_id = 'r0'").first().findings
    assert [(f.ioc_id, f.type, f.matched) for f in first][:3] == [
        ("key", "file", True),
        ("log", "file", False),
        ("gone", "file", True),
    ]


def test_many_indicators_ask_for_the_same(spark):
    """The same condition in many scenarios and runs, and another run's scenario."""
    runs = [f"r{i}" for i in range(6)]
    data = [(r, *i) for r in runs for i in (KEY_FILE, ANY)]
    expected = expected_of(spark, data).withColumn(
        "scenario_id", F.expr("concat('s', substr(run_id, 2) % 2)")
    )
    definitions = expected.drop("run_id", "ordinal").dropDuplicates(["scenario_id", "ioc_id"])
    entries = entries_of(
        spark, [("r0", KEYS, 1, "marker", "l"), ("r1", "/x", 1, "two words and more", "l")] * 20
    )
    for given in (None, definitions):
        findings = ioc.detect_iocs(expected, ioc.Evidence(entries), given)
        assert findings.count() == 12
        assert rows(findings.where("matched"), "run_id", "scenario_id", "ioc_id") == [
            ("r0", "s0", "key"), ("r1", "s1", "any")
        ]
    for match, n in ((ioc.match_file_iocs, 2), (ioc.match_content_iocs, 2)):
        assert match(entries, definitions).count() == n


def test_matchers_by_type(spark):
    expected = expected_of(spark, [("r", *REGISTRY), ("r", *LOG)])
    everything = lambda expected, definitions, evidence: expected
    findings = ioc.detect_iocs(expected, ioc.Evidence(), matchers={"registry": everything})
    assert rows(findings, "ioc_id", "matched") == [("log", False), ("reg", True)]
    assert rows(ioc.detect_iocs(expected, ioc.Evidence(), matchers={}), "matched") == [(False,), (False,)]


def test_content_is_read_only_if_asked_for(spark, tmp_path):
    path = str(tmp_path / "entries")
    entries_of(spark, [("r", "/var/log/auth.log", 0, "text", "stat")]).write.parquet(path)
    entries = spark.read.parquet(path)
    schema = lambda iocs: [
        line for line in ioc.match_file_iocs(entries, expected_of(spark, iocs))
        ._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line
    ][0].split("ReadSchema")[1]
    assert "content" not in schema([("r", *LOG)])
    assert "content" in schema([("r", *KEY_FILE)])


# --- content against brute force -----------------------------------------------


def random_texts(rng, n):
    words = ["ab", "b", "abc", "", "x\ny", "é", "word", "other", "-"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(n)]
    # A third are copies of one text.
    return [texts[0] if i % 3 == 0 else t for i, t in enumerate(texts)] + [None]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    "sizes",
    [
        {},
        {"scan_markers": 0},
        {"scan_markers": 0, "broadcast_rows": 5, "rows_per_task": 4},
    ],
    ids=["scan", "by_gram", "shuffled"],
)
def test_content_hits(spark, seed, sizes):
    rng = random.Random(seed)
    texts = list(enumerate(random_texts(rng, 90)))
    long = [t for _, t in texts if t and len(t) > 6]
    markers = {"", "ab", "b abc", " "}
    for _ in range(30):
        text = rng.choice(long)
        start = rng.randrange(len(text) - 3)
        markers.add(text[start : start + rng.randrange(2, 12)])
    markers = list(enumerate(sorted(markers)))
    want = sorted((d, m) for d, t in texts if t is not None for m, k in markers if k in t)
    got = ioc.content_hits(
        spark.createDataFrame(texts, "doc int, content string"),
        spark.createDataFrame([*markers, (999, None)], "m int, content_contains string"),
        keep=["doc"],
        limits=ioc.Limits(**sizes),
    )
    assert sorted((r.doc, r.m) for r in got.collect()) == want


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_file_iocs_both_ways(spark, broadcast_rows):
    rng = random.Random(3)
    paths = ["/hot"] * 10 + [f"/p{i}" for i in range(20)]
    entries = [
        (f"r{rng.randrange(5)}", rng.choice(paths), rng.choice([0, 1, None]), rng.choice(["abc", "b", None]), "s")
        for _ in range(200)
    ] + [("r0", "/hot", 0, "abc", "s")] * 100
    wanted = [
        (f"i{n}", p, rng.choice([0, 1, None]), rng.choice(["b", "abc", None]))
        for n, p in enumerate(["/hot", "/hot", "/hot", *paths[10:], "/none"])
    ]
    want = {
        (r, "s", i)
        for r, p, z, c, _ in entries
        for i, q, y, k in wanted
        if p == q and (y is None or z == y) and (k is None or (c is not None and k in c))
    }
    iocs = spark.createDataFrame(
        [("s", i, p, z, k) for i, p, z, k in wanted],
        "scenario_id string, ioc_id string, path string, size_bytes bigint, content_contains string",
    )
    got = ioc.match_file_iocs(entries_of(spark, entries), iocs, limits=ioc.Limits(64, broadcast_rows, 10))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_process_iocs_both_ways(spark, broadcast_rows):
    rng = random.Random(4)
    value = lambda: rng.choice(["1", "2", "3", None])
    rows_ = [
        (f"r{rng.randrange(4)}", rng.choice("pq"), {k: value() for k in rng.sample("abc", rng.randrange(4))})
        for _ in range(60)
    ] + [("r0", "p", {"a": "1", "b": "2"})] * 40
    iocs = [
        (f"i{n}", rng.choice("pq"), {k: value() for k in rng.sample("abc", rng.randrange(4))})
        for n in range(25)
    ] + [("nothing", "p", None), ("no-plugin", None, {"a": "1"})]
    want = {
        (r, "s", i)
        for r, p, row in rows_
        for i, q, wanted in iocs
        if p == q and all(row.get(k) == v for k, v in (wanted or {}).items())
    }
    got = ioc.match_process_iocs(
        spark.createDataFrame(rows_, "run_id string, plugin string, attrs map<string,string>"),
        spark.createDataFrame(
            [("s", *i) for i in iocs],
            "scenario_id string, ioc_id string, plugin string, attrs map<string,string>",
        ),
        limits=ioc.Limits(64, broadcast_rows, 10),
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_detect_all_kinds_from_files(spark, fixture_path):
    from tracewell import sources

    truth = sources.ground_truth_iocs(sources.read_ground_truth(spark, fixture_path("ground_truth")))
    runs = spark.createDataFrame([("run-a", "keys"), ("run-b", "keys")], "run_id string, scenario_id string")
    expected = runs.join(truth, "scenario_id").drop("evasion_note")
    entries = entries_of(
        spark,
        [
            ("run-a", KEYS, 10, "x marker-key", "disk_list"),
            ("run-a", "/var/log/auth.log", 0, None, "disk_stat"),
            ("run-b", "/root/.history", 10, None, "disk_list"),
        ],
    )
    tool_rows = sources.read_plugin_rows(spark, fixture_path("tool_output"))
    findings = ioc.detect_iocs(expected, ioc.Evidence(entries, tool_rows))
    assert rows(findings.where("matched"), "run_id", "ioc_id") == [
        ("run-a", "history-absent"),
        ("run-a", "key-file"),
        ("run-a", "log-truncated"),
        ("run-a", "process"),
    ]
    assert findings.count() == 8


# --- one pass ---------------------------------------------------------------------


def scans_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "ReadSchema" in line and "entries" in line]


def test_entries_are_read_once_for_paths_and_once_for_texts(spark, tmp_path):
    path = str(tmp_path / "entries")
    entries_of(spark, [("r", KEYS, 9, "a marker two words and more", "list")]).write.parquet(path)
    expected = expected_of(spark, [("r", *i) for i in ALL])
    findings = ioc.detect_iocs(expected, ioc.Evidence(spark.read.parquet(path)))
    assert len(scans_of(findings)) == 2
    assert {f.ioc_id for f in findings.collect() if f.matched} == {"key", "any", "gone"}
    no_text = ioc.detect_iocs(expected.where("content_contains IS NULL"), ioc.Evidence(spark.read.parquet(path)))
    assert len(scans_of(no_text)) == 1 and "content" not in scans_of(no_text)[0].split("ReadSchema")[1]


@pytest.mark.parametrize("limits", [ioc.Limits(), ioc.Limits(0, 0, 20)], ids=["sent", "shuffled"])
def test_one_pass_like_the_matchers(spark, limits):
    """Over 64 conditions of all kinds, repeated and clashing, against the matcher of each type."""
    rng = random.Random(11)
    data = []
    for run in ("a", "b", "c"):
        for n in range(40):
            path = f"/p{rng.randrange(30)}"
            kind = rng.choice(["path", "size", "marked", "gone", "text", "row", "bare", "odd"])
            attributes = {
                "path": {"path": path}, "size": {"path": path, "size_bytes": rng.randrange(3)},
                "marked": {"path": path, "content_contains": rng.choice("xyz")}, "gone": {"path": path, "exists": False},
                "text": {"content_contains": rng.choice(["x y", "z", "w w", "none"])}, "odd": {"exists": False},
                "row": {"plugin": rng.choice("pq"), "k": str(rng.randrange(4))}, "bare": {"plugin": "p", "missing": None},
            }[kind]
            sources = rng.choice([None, [], ["s"], ["t", "s"], ["u"]])
            data.append((run, f"{kind}-{n}", "process" if kind in ("row", "bare") else "file", attributes, sources))
    expected = expected_of(spark, [*data, ("a", "other", "registry", {}, None), ("none", *GONE), ("none", *LOG)])
    texts = ["x y", "z", "y w w x", None, ""]
    entries = [(rng.choice("abc"), f"/p{rng.randrange(30)}", rng.choice([0, 1, 2, None]), rng.choice(texts), rng.choice("st")) for _ in range(60)]
    tool = spark.createDataFrame(
        [(rng.choice("abz"), rng.choice("pq"), {"k": str(rng.randrange(4))}) for _ in range(30)],
        "run_id string, plugin string, attrs map<string,string>",
    )
    evidence = ioc.Evidence(entries_of(spark, entries * 2), tool)
    key = ["run_id", "ioc_id", "matched"]
    want = rows(ioc.detect_iocs(expected, evidence, matchers=ioc.MATCHERS), *key)
    for definitions in (None, expected.drop("run_id")):
        assert rows(ioc.findings_in_one_pass(expected, evidence, definitions, limits), *key) == want
    assert rows(ioc.findings_in_one_pass(expected, evidence, None, limits, every_look=True), *key) == want
    assert {r[2] for r in rows(ioc.findings_in_one_pass(expected, ioc.Evidence()), *key)} == {False}


# --- levels -----------------------------------------------------------------------


def test_presence_and_outcome_by_level(spark):
    step = lambda levels, *ids: (levels, [(i,) for i in ids])
    steps = spark.createDataFrame(
        [("s", *step(["none", "high"], "log")), ("s", *step(["high"], "gone", "gone")), ("s", *step(None, "never")), ("s", *step(["high"]))],
        "scenario_id string, evasion_levels array<string>, expected_iocs array<struct<id: string>>",
    )
    iocs = expected_of(spark, [(None, *LOG), (None, *GONE), (None, "spare", "file", {"path": "/x"}, None)]).drop("run_id")
    grid = ioc.level_grid(steps, iocs)
    assert rows(grid, "level", "ioc_id", "presence") == [
        ("high", "gone", "expected"), ("high", "log", "expected"), ("high", "spare", "not_assessed"),
        ("none", "gone", "not_expected"), ("none", "log", "expected"), ("none", "spare", "not_assessed"),
    ]
    runs = spark.createDataFrame(
        [(r, "s", level) for r, level in (("h1", "high"), ("h2", "high"), ("n1", "none"), ("n2", "none"), ("dark", "none"))],
        "run_id string, scenario_id string, level string",
    )
    entries = entries_of(
        spark,
        [("h1", "/var/log/auth.log", 0, None, "stat"), ("h2", "/root/.history", 1, None, "list"),
         ("n1", "/var/log/auth.log", 5, None, "stat"), ("n1", "/y", 5, None, "list"), ("n2", "/root/.history", 5, None, "list")],
    )
    found = ioc.findings_at_level(runs, grid, ioc.Evidence(entries))
    got = {(r, i): o for r, i, o in rows(found, "run_id", "ioc_id", "outcome") if i != "spare"}
    assert got == {
        ("h1", "log"): "found", ("h1", "gone"): "not_assessed", ("h2", "log"): "not_assessed", ("h2", "gone"): "missed",
        ("n1", "log"): "missed", ("n1", "gone"): "unexpected", ("n2", "log"): "not_assessed", ("n2", "gone"): "absent",
        ("dark", "log"): "not_assessed", ("dark", "gone"): "not_assessed",
    }
    assert {o for _, i, o in rows(found, "run_id", "ioc_id", "outcome") if i == "spare"} == {"not_assessed"}
    by = outcome_metrics(found, ["level"])
    assert rows(by, "level", "tp", "fn", "fp", "tn", "recall", "precision") == [("high", 1, 1, 0, 0, 0.5, 1.0), ("none", 0, 1, 1, 1, 0.0, 0.0)]


def test_grid_is_not_broadcast(spark, tmp_path):
    """What documents hold is larger than Spark takes it for, and they are read once for each part."""
    steps = spark.createDataFrame(
        [("s", ["none", None], [("log",)]), ("s", [], [("gone",)]), ("t", ["high"], [("log",), (None,)])],
        "scenario_id string, evasion_levels array<string>, expected_iocs array<struct<id: string>>",
    )
    expected_of(spark, [(None, *LOG), (None, *GONE)]).drop("run_id").write.parquet(f"{tmp_path}/iocs")
    steps.write.parquet(f"{tmp_path}/steps")
    grid = ioc.level_grid(spark.read.parquet(f"{tmp_path}/steps"), spark.read.parquet(f"{tmp_path}/iocs"))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("ReadSchema") == 3
    told = {(level, i): p for level, i, p in rows(grid.where("scenario_id = 's'"), "level", "ioc_id", "presence")}
    assert told == {
        ("none", "log"): "expected", ("none", "gone"): "not_expected", (None, "log"): "not_expected", (None, "gone"): "not_expected",
    }
