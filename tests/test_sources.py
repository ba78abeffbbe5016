import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell import schemas, sources
from tracewell.functions import render_template
from tracewell.operators.integrity import duplicate_keys, first_match, segment_totals, validate_segments
from tracewell.operators.ioc import active_steps, expected_at_level
from tracewell.operators.metrics import normalize_truth, probe_images
from tracewell.session import work_path
from tracewell.sources import files


def test_plugin_rows(spark, fixture_path):
    found = sources.read_plugin_rows(spark, fixture_path("tool_output"))
    counts = rows(found.groupBy("run_id", "plugin").count())
    assert counts == [
        ("run-a", "linux.pslist", 2),
        ("run-b", "linux.pslist", 1),
        ("run-c", "linux.pslist", 2),
        ("run-h", "linux.pstree", 1),
    ]
    assert rows(found.where("run_id = 'run-a'"), "pos", "attrs") == [
        (0, {"PID": "1", "COMM": "init"}),
        (1, {"PID": "2", "COMM": "sshd"}),
    ]
    nested = found.where("run_id = 'run-h'").first()["attrs"]
    assert nested["__children"] == '[{"PID":2}]'


def test_probe(spark, fixture_path):
    found = sources.read_plugin_rows(spark, fixture_path("tool_output"))
    images = spark.createDataFrame([(f"run-{c}",) for c in "abcd"], "run_id string")
    assert rows(probe_images(found, images)) == [
        ("run-a", 2, True),
        ("run-b", 1, True),
        ("run-c", 2, False),
        ("run-d", 0, False),
    ]


@pytest.mark.parametrize("payload", ["not json", "", '[{"PID":1}] trailing', None])
def test_invalid_json(spark, payload):
    df = spark.createDataFrame([("r", payload), ("s", "[{}]")], "run_id string, payload string")
    with pytest.raises(Exception, match="not valid JSON"):
        sources.plugin_rows(df, "payload").collect()
    assert rows(sources.plugin_rows(df, "payload", "quarantine"), "run_id") == [("s",)]
    assert rows(sources.plugin_quarantine(df, "payload"), "run_id") == [("r",)]


def test_ground_truth(spark, fixture_path):
    docs = sources.read_ground_truth(spark, fixture_path("ground_truth"))
    assert docs.count() == 3
    found = sources.ground_truth_iocs(docs)
    assert rows(found, "ordinal", "ioc_id", "path", "content_contains", "exists", "size_bytes") == [
        (0, "key-file", "/home/u/.ssh/authorized_keys", "marker-key", None, None),
        (1, "history-absent", "/root/.history", None, False, None),
        (2, "log-truncated", "/var/log/auth.log", None, None, 0),
        (3, "process", None, None, None, None),
    ]
    process = found.where("type = 'process'").first()
    assert process["plugin"] == "linux.pslist"
    assert process["attrs"] == {"PID": "2", "COMM": "sshd"}


def test_normalize_truth(spark, fixture_path):
    read = lambda name: sources.read_ground_truth(spark, fixture_path(f"ground_truth/{name}.json"))
    truth = normalize_truth(
        read("described").select("scenario_id", "scenario"),
        read("executed").select("guid", "name", "stdout"),
        read("indicators").select("scenario_id", "iocs"),
    )
    assert rows(truth, "shape", "scenario_id", "guid", F.size("iocs")) == [
        ("described", "ubuntu-22.04_clear-history_20260102-030405", None, None),
        ("executed", None, "g-1", None),
        ("indicators", "keys", None, 4),
    ]


def test_scenarios(spark, fixture_path):
    steps, iocs = sources.read_scenarios(spark, fixture_path("scenario"))
    assert rows(steps, "ordinal", "step_id", "phase")[:2] == [
        (0, "look", "reconnaissance"),
        (1, "add-key", "persistence"),
    ]
    command = render_template(F.col("command"), F.col("defaults"), "braces")
    assert steps.where("ordinal = 1").select(command).first()[0] == (
        "add marker-key to /home/u by {{unknown}}"
    )
    assert rows(iocs, "ioc_id", "evasion_note") == [("authorized-keys-file", "present at all levels")]
    assert rows(active_steps(steps), "level", "n_steps") == [("high", 5), ("none", 2), ("normal", 4)]
    everything = ["auth-log-truncated", "authorized-keys-file", "bash-history-absent"]
    assert rows(expected_at_level(steps), "level", "ioc_id") == [
        *[("high", i) for i in everything],
        ("none", "authorized-keys-file"),
        *[("normal", i) for i in everything],
    ]


def test_catalog(spark, fixture_path):
    pytest.importorskip("yaml")
    tests = sources.read_catalog(spark, fixture_path("catalog.yaml"))
    first, second = sorted(tests.collect(), key=lambda t: t.ordinal)
    assert (first.technique_id, first.guid, first.name) == ("T1070.003", "guid-1", "two spaces")
    assert first.description == "First line\nsecond line\n"
    assert first.argument_defaults == {"history_path": "~/.history", "count": "3"}
    assert (first.executor, first.elevation_required, first.cleanup_command) == ("sh", True, None)
    assert first.dependencies[0].description == "a tool"
    assert (second.supported_platforms, second.elevation_required) == (["windows"], False)
    assert second.input_arguments is None and second.dependencies is None


def test_registry(spark, fixture_path):
    pytest.importorskip("yaml")
    assert rows(sources.read_registry(spark, fixture_path("registry.yaml"))) == [
        ("broken", None, "guid-1", False),
        ("every", "T1070.003", "", False),
        ("one", "T1070.003", "guid-2", True),
    ]
    assert rows(sources.read_registry(spark, fixture_path("empty.yaml"))) == []


def test_profiles(spark, fixture_path):
    pytest.importorskip("yaml")
    found = sources.read_profiles(spark, fixture_path("profiles"))
    assert rows(found, "file_name", "distro_id", "filename", "checksum_algo") == [
        ("debian-13.yaml", "debian-13", None, "sha512"),
        ("ubuntu-24.04-2.yaml", "ubuntu-24.04", "noble.img", "sha256"),
        ("ubuntu-24.04.yaml", "ubuntu-24.04", "noble.img", "sha256"),
    ]
    assert rows(duplicate_keys(found, "distro_id", "file_name")) == [
        ("ubuntu-24.04", 2, "ubuntu-24.04-2.yaml"),
        ("ubuntu-24.04", 2, "ubuntu-24.04.yaml"),
    ]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_profiles(spark, fixture_path("no-such-folder"))


@pytest.mark.parametrize(
    "line, want",
    [
        ("ABC  img.qcow2", ("abc", "img.qcow2")),
        ("abc *img.qcow2", ("abc", "img.qcow2")),
        ("abc ./img.qcow2", ("abc", "img.qcow2")),
        ("abc *./img.qcow2", ("abc", "./img.qcow2")),
        ("abc .hidden", ("abc", "hidden")),
        ("\tabc  x  y\x1f", ("abc", "y")),
        ("abc", None),
        ("  abc  ", None),
        ("", None),
    ],
)
def test_checksum_line(spark, line, want):
    df = spark.createDataFrame([(f"h1 first\r\n{line}\x85h3 last",)], "text string")
    found = sources.checksum_lines(df, "text").where("line_no = 1")
    assert rows(found, "hash", "file_name") == ([want] if want else [])


def test_first_listed_counts(spark):
    df = spark.createDataFrame([("l", "a f\nb f\nc g")], "list_id string, text string")
    lines = sources.checksum_lines(df, "text")
    best = first_match(lines, ["list_id", "file_name"], ["line_no"])
    assert rows(best, "file_name", "hash") == [("f", "a"), ("g", "c")]


@pytest.mark.parametrize(
    "stdout, guid, want",
    [
        ('noise\n\n  g {"name":"x"}', "g", '{"name":"x"}'),
        ('g\ng \ng {"name":"y"}', "g", '{"name":"y"}'),
        ('g {bad\ng {"name":"z"}', "g", None),
        ("nothing\nhere", "g", None),
        ("", "g", None),
        ('\n \n{"name":"any"}', "", '{"name":"any"}'),
        ('g-1 {"a":1} trailing', "g-1", None),
    ],
)
def test_run_log(spark, stdout, guid, want):
    df = spark.createDataFrame([(stdout, guid)], "stdout string, guid string")
    result = sources.parse_run_log(df, "stdout", "guid").select(F.to_json("result"))
    assert result.first()[0] == want


def test_segments_and_digests(spark, tmp_path):
    sizes = {"a.E01": 5, "a.E02": 3, "a.E10": 4, "b.E01": 0, "b.raw": 9, "c.E1": 1}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(b"x" * size)
    segments = sources.list_segments(spark, str(tmp_path))
    name = F.substring_index("image_id", "/", -1)
    assert segments.where(F.col("image_id").startswith("/") | F.col("image_id").startswith("file:")).count() == 4
    segments = segments.withColumn("image_id", name)
    totals = segment_totals(segments.where("image_id = 'a'")).first()
    assert (totals.n_segments, totals.size_bytes, totals.ewf_size_bytes) == (3, 5, 12)
    assert [p.rsplit("/", 1)[1] for p in totals.segments] == ["a.E01", "a.E02", "a.E10"]
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    assert rows(validate_segments(images, segments)) == [
        ("a", 3, 0, True),
        ("b", 1, 1, False),
        ("c", 0, 0, False),
    ]
    files = segments.select("path").withColumn(
        "algo", F.when(F.col("path").endswith("E02"), "sha512").otherwise("sha256")
    )
    digests = {r.path.rsplit("/", 1)[1]: r.digest for r in sources.file_digests(files).collect()}
    assert digests["a.E01"] == hashlib.sha256(b"xxxxx").hexdigest()
    assert digests["a.E02"] == hashlib.sha512(b"xxx").hexdigest()


def test_folders_of_many_runs(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "disk.E01").write_bytes(b"x")
    folders = spark.createDataFrame([(f"file://{tmp_path}/{r}",) for r in ("r1", "r2")], "folder string")
    assert rows(sources.list_segments(spark, folders), "path") == [
        (f"file://{tmp_path}/r1/disk.E01",),
        (f"file://{tmp_path}/r2/disk.E01",),
    ]


def test_empty_tool_output(spark, tmp_path):
    (tmp_path / "r1__p.json").write_text("")
    (tmp_path / "r2__p.json").write_text("[{}]")
    bad = sources.read_plugin_quarantine(spark, str(tmp_path))
    assert rows(bad) == [("r1", "p", "")]
    assert rows(sources.read_plugin_rows(spark, str(tmp_path), "quarantine"), "run_id") == [("r2",)]
    with pytest.raises(Exception, match="not valid JSON"):
        sources.read_plugin_rows(spark, str(tmp_path)).collect()


def test_symbols(spark, tmp_path):
    for name in ("ubuntu_5.15.0-91.json", "ubuntu_5.15.0-101_x.json", "plain.json", "ubuntu_1.txt"):
        (tmp_path / name).write_text("{}")
    assert rows(sources.list_symbols(spark, str(tmp_path))) == [
        ("ubuntu", "5.15.0-101_x", "ubuntu_5.15.0-101_x.json"),
        ("ubuntu", "5.15.0-91", "ubuntu_5.15.0-91.json"),
    ]


def test_manifest_round_trip(spark, tmp_path):
    image = "struct<path:string,tool:string,sha256:string,size_bytes:bigint,timestamp:double,segments:array<string>,acquisition_seconds:double,virtual_size_bytes:bigint,ewf_size_bytes:bigint>"
    memory = ("m.raw", "dump", None, 7, 10.5, None, None, None, None)
    disk = ("d.E01", "convert", "ab", 5, 11.5, ["d.E01", "d.E02", "d.E03"], 1.25, 100, 9)
    given = spark.createDataFrame(
        [("run-1", 12.5, memory, disk), ("run-2", 13.0, memory, None)],
        f"scenario_id string, created_at double, memory_image {image}, disk_image {image}",
    )
    path = str(tmp_path / "manifests")
    sources.write_manifests(given, path)
    runs, images = sources.read_manifests(spark, path, multi_line=False)
    assert rows(runs) == [("run-1", 12.5), ("run-2", 13.0)]
    assert rows(images) == [
        ("run-1", "disk", *disk),
        ("run-1", "memory", *memory),
        ("run-2", "memory", *memory),
    ]
    written = "".join(p.read_text() for p in (tmp_path / "manifests").rglob("*.json"))
    assert '"sha256":null' in written


def test_ground_truth_of_a_cleanup_run_is_not_written(spark, tmp_path):
    given = spark.createDataFrame(
        [("r1", "x", False), ("r2", None, None), ("r3", "y", True)], "run_id string, result string, cleanup boolean"
    )
    path = str(tmp_path / "truth")
    sources.write_ground_truth(given, path, cleanup="cleanup")
    assert rows(spark.read.json(path), "run_id", "result") == [("r1", "x"), ("r2", "{}")]


def test_rows_of_any_size(spark):
    one = F.concat(F.lit('[{"a":"'), F.repeat(F.lit("x"), 25_000_000), F.lit('"},{"b":1.50}]'))
    row = F.concat(F.lit('{"a":"'), F.repeat(F.lit("y"), 100_000), F.lit('"},'))
    many = F.concat(F.lit('{"rows":['), F.repeat(row, 1_400), F.lit("{}]}"))
    for payload, n in ((one, 2), (many, 1_401)):
        df = spark.range(1).select("id", payload.alias("payload"))
        assert sources.plugin_rows(df, "payload").count() == n
        assert sources.plugin_quarantine(df, "payload").count() == 0


def test_rows_that_cannot_be_read(spark):
    df = spark.createDataFrame([('{"rows":[{"a":1,"a":2}]}',), ('{"rows":{}}',), ("{}",)], "payload string")
    assert sources.plugin_rows(df.offset(1), "payload").count() == 0
    assert sources.plugin_quarantine(df, "payload").count() == 1
    with pytest.raises(Exception, match="cannot be read"):
        sources.plugin_rows(df, "payload").collect()


READERS = {
    sources.read_ground_truth: schemas.GROUND_TRUTH, sources.read_scenarios: schemas.SCENARIO, sources.read_manifests: schemas.MANIFEST,
}


@pytest.mark.parametrize("read", READERS)
@pytest.mark.parametrize("text, verdict", [
    ('{"scenario_id": "s", "iocs": [{"id"', "broken"), ("no json", "broken"), ('{"id": "s"} garbage', "trailing"),
    ('{"id": "s"}\n{"id": "t"}', "trailing"), ("", "empty"), (" \n", "empty"), ('[{"id": "s"}]', "shape"), ("null", "shape"),
    ('{"scenario_id": "s", "iocs": 5, "steps": 5, "created_at": "then"}', "shape"),
])
def test_one_verdict_in_both_modes(spark, tmp_path, read, text, verdict):
    (tmp_path / "doc.json").write_text(text)
    first = lambda found: found[0] if isinstance(found, tuple) else found
    with pytest.raises(Exception, match=rf"cannot be taken \({verdict}\).*doc\.json"):
        first(read(spark, str(tmp_path))).count()
    assert first(read(spark, str(tmp_path), mode="quarantine")).count() == 0
    assert rows(sources.read_quarantine(spark, str(tmp_path), READERS[read]), "verdict", "text") == [(verdict, text)]


def test_strings_of_any_length_in_both_modes(spark, tmp_path):
    marker = "m" * 25_000_000
    (tmp_path / "doc.json").write_text(
        '{"scenario_id": "s", "iocs": [{"id": "i", "type": "file", "attributes": {"content_contains": "' + marker + '"}}]}'
    )
    for mode in ("fail", "quarantine"):
        docs = sources.read_ground_truth(spark, str(tmp_path), mode=mode)
        assert rows(sources.ground_truth_iocs(docs), F.length("content_contains")) == [(25_000_000,)]


def test_hidden_files_are_no_documents(spark, tmp_path):
    for name in ("_SUCCESS", ".doc.json.crc", "sub/empty.json", "_tmp/run=1/empty.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "doc.json").write_text('{"scenario_id": "s"}')
    assert rows(sources.read_ground_truth(spark, str(tmp_path)), "scenario_id") == [("s",)]
    assert sources.read_quarantine(spark, str(tmp_path), schemas.GROUND_TRUTH).count() == 0


def test_listing_of_many_folders_and_of_one_large_folder(spark, tmp_path, monkeypatch):
    for i in range(10_000):
        (tmp_path / "deep" / f"a{i % 20}" / f"b{i}").mkdir(parents=True)
    for i in range(0, 10_000, 100):
        (tmp_path / "deep" / f"a{i % 20}" / f"b{i}" / "f.E01").write_text("x" * (i % 7))
    (tmp_path / "flat").mkdir()
    for i in range(100_000):
        (tmp_path / "flat" / f"{i}.E01").touch()
    made = []
    monkeypatch.setattr(files, "work_path", lambda s, name: made.append(name) or work_path(s, name))
    found = sources.list_files(spark, [str(tmp_path / "deep"), str(tmp_path / "flat")])
    assert 1 < len(made) < 8
    assert found.count() == 100_100 and found.select("path").distinct().count() == 100_100
    assert found.agg(F.sum("size_bytes")).first()[0] == sum(i % 7 for i in range(0, 10_000, 100))
    made.clear()
    assert rows(sources.list_files(spark, str(tmp_path / "flat" / "5.E01")), "path") == [(str(tmp_path / "flat" / "5.E01"),)]
    assert len(made) == 1


@pytest.mark.parametrize("name, value, want", [
    ("size_bytes", "0.0", 0), ("size_bytes", "1e3", 1000), ("size_bytes", "ten", "raise"), ("size_bytes", "1.5", "raise"),
    ("exists", "no way", "raise"), ("exists", "false", False),
])
def test_conditions_are_never_dropped(spark, name, value, want):
    kind = "scenario_id string, iocs array<struct<id: string, type: string, attributes: map<string,string>, sources: array<string>, evasion_note: string>>"
    docs = spark.createDataFrame([("s", [("i", "file", {name: value}, None, None)])], kind)
    found = sources.ground_truth_iocs(docs).select(name)
    if want == "raise":
        with pytest.raises(Exception, match=f"cannot read {name}"):
            found.collect()
    else:
        assert found.first()[0] == want


def test_tool_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "run+a__linux.pslist.json").write_text('[{"PID":1}]')
    (tmp_path / "deep" / "run-b__linux.pslist.json").write_text("")
    assert rows(sources.read_plugin_rows(spark, str(tmp_path), "quarantine"), "run_id", "plugin") == [("run+a", "linux.pslist")]
    assert rows(sources.read_plugin_quarantine(spark, str(tmp_path)), "run_id") == [("run-b",)]
    (tmp_path / "other.json").write_text("[]")
    with pytest.raises(Exception, match="not a name of tool output"):
        sources.read_plugin_rows(spark, str(tmp_path), "quarantine").collect()


def test_placeholders_in_indicators(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"id": "s", "defaults": {"home": "/home/u", "key": "k1"}, "steps": [], "ground_truth": {"iocs": [{"id": "i", '
        '"type": "file", "attributes": {"path": "{{home}}/keys", "content_contains": "{{key}} {{other}}"}}]}}'
    )
    _, iocs = sources.read_scenarios(spark, str(tmp_path))
    assert rows(iocs, "path", "content_contains") == [("/home/u/keys", "k1 {{other}}")]


def test_writers_leave_other_runs(spark, tmp_path):
    path = str(tmp_path / "out")
    kind = "run_id string, scenario_id string, result struct<name: string>, cleanup boolean"
    for name, result, cleanup in (("r1", ("a",), False), ("r2", None, False), ("r3", None, True), ("r2", ("b",), False)):
        sources.write_ground_truth(spark.createDataFrame([(name, "s", result, cleanup)], kind), path, cleanup="cleanup")
    back = spark.read.schema("run_id string, scenario_id string, result struct<name: string>").json(path)
    assert rows(back, "run_id", "result.name") == [("r1", "a"), ("r2", "b")]


def test_a_document_is_parsed_once_for_each_question(spark, tmp_path):
    """Whether it is one value, what it says, and (twice, but only if it is none) what it begins with."""
    (tmp_path / "manifests.json").write_text('{"scenario_id": "a", "created_at": 1.5, "disk_image": {"path": "p", "segments": ["x"]}}\n')
    for df in sources.read_manifests(spark, str(tmp_path), multi_line=False):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 4
        assert df.count() == 1
