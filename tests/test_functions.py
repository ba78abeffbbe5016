import pytest
from pyspark.sql import functions as F

from tracewell import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "size, text",
    [
        (None, "unknown"),
        (0, "0 B"),
        (1023, "1023 B"),
        (1024, "1.0 KiB"),
        (1280, "1.2 KiB"),
        (1408, "1.4 KiB"),
        (100608, "98.2 KiB"),
        (1024**2 - 1, "1024.0 KiB"),
        (1024**2, "1.0 MiB"),
        (5 * 1024**3 // 2, "2.5 GiB"),
        (2**50, "1.0 PiB"),
        (2**60, "1024.0 PiB"),
    ],
)
def test_format_bytes(spark, size, text):
    assert one(spark, fn.format_bytes(F.lit(size).cast("bigint"))) == text


@pytest.mark.parametrize(
    "column, value",
    [
        (fn.distro_family, {"ubuntu-22.04": "ubuntu", "arch": "arch", "a-b-c": "a"}),
        (
            fn.url_filename,
            {"http://h/a/b.img": "b.img", "http://h/a/b//": "b", "plain": "plain"},
        ),
        (
            fn.strip_marker,
            {"*img": "img", "./img": "img", "*./img": "./img", ".hidden": "hidden", "..//**x": "x"},
        ),
    ],
)
def test_text_to_text(spark, column, value):
    for given, want in value.items():
        assert one(spark, column(F.lit(given))) == want


def test_symbol_filename(spark):
    name = fn.symbol_filename(F.lit("ubuntu-22.04"), F.lit("5.15.0/91"))
    assert one(spark, name) == "ubuntu_5.15.0_91.json"


def test_effective_filename(spark):
    url = F.lit("http://h/disk.img")
    assert one(spark, fn.effective_filename(F.lit("x.img"), url)) == "x.img"
    assert one(spark, fn.effective_filename(F.lit(""), url)) == "disk.img"
    assert one(spark, fn.effective_filename(F.lit(None).cast("string"), url)) == "disk.img"


def test_run_id_and_back(spark):
    ts = F.lit("2026-05-17 19:40:11").cast("timestamp_ntz")
    run_id = fn.build_run_id(F.lit("ubuntu-22.04"), F.lit("a_b_c"), ts)
    assert one(spark, run_id) == "ubuntu-22.04_a_b_c_20260517-194011"
    parsed = one(spark, fn.parse_run_id(run_id))
    assert (parsed.distro, parsed.scenario) == ("ubuntu-22.04", "a_b_c")
    assert str(parsed.ts) == "2026-05-17 19:40:11"


@pytest.mark.parametrize("bad", ["", "a_b", "a_b_20261301-000000", "a_b_2026-01-01", "_b_20260101-000000"])
def test_malformed_run_id(spark, bad):
    assert one(spark, fn.parse_run_id(F.lit(bad))) is None


def test_render_template(spark):
    args = F.create_map(F.lit("a"), F.lit("#{b}"), F.lit("b"), F.lit("{{a}}"))
    render = lambda text, style: one(spark, fn.render_template(F.lit(text), args, style))
    # A value that looks like a placeholder is left as it is.
    assert render("x #{a} y #{b} #{c}\n# {", "hash") == "x #{b} y {{a}} #{c}\n# {"
    assert render("{{a}}{{b}}{{c}} { }}", "braces") == "#{b}{{a}}{{c}} { }}"
    assert render("", "hash") == ""


def test_digest(spark):
    digest = lambda algo: one(spark, fn.digest(F.lit("abc"), F.lit(algo)))
    assert digest("sha256") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert digest("SHA512").startswith("ddaf35a193617abacc417349ae204131")
    assert digest("md5") is None


def test_technique(spark):
    assert one(spark, fn.technique_full(F.lit("T1070"), F.lit("003"))) == "T1070.003"
    assert one(spark, fn.technique_full(F.lit("T1070"), F.lit(None).cast("string"))) == "T1070"
    assert tuple(one(spark, fn.technique_parts(F.lit("T1070.003")))) == ("T1070", "003")
    assert tuple(one(spark, fn.technique_parts(F.lit("T1070")))) == ("T1070", None)


def test_paths(spark):
    relative = lambda path, mode="null": one(
        spark, fn.relative_path(F.lit(path), F.lit("/lab"), mode)
    )
    assert relative("/lab/dumps/x") == "dumps/x"
    assert relative("/laboratory/x") is None
    with pytest.raises(Exception, match="is not below"):
        relative("/laboratory/x", "error")
    assert one(spark, fn.rebase_path(F.lit("dumps/x"), F.lit("/lab/"))) == "/lab/dumps/x"
    assert one(spark, fn.rebase_path(F.lit("/dumps/x"), F.lit("/lab"))) == "/dumps/x"


@pytest.mark.parametrize(
    "row, has", [('{"PID":1}', True), ('{"PID":""}', False), ('{"PID":null}', False), ("{}", False), ("7", False)]
)
def test_has_value(spark, row, has):
    assert one(spark, fn.has_value(F.parse_json(F.lit(row)), "PID")) is has


@pytest.mark.parametrize(
    "text, value",
    [("[1]", "[1]"), (' {"a":1} ', '{"a":1}'), ("null", "null"), ("1 2", None), ("1,2", None),
     ("", None), ("not json", None), ('{"a":1} x', None), ("1] x", None), ('"k": 87}', None)],
)
def test_json_value(spark, text, value):
    assert one(spark, F.to_json(fn.json_value(F.lit(text)))) == value


def test_resolve_args(spark):
    defaults = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    overrides = F.create_map(
        F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4"), F.lit("a"), F.lit(None).cast("string")
    )
    assert one(spark, fn.resolve_args(defaults, overrides)) == {"a": "1", "b": "3", "c": "4"}
    none = F.lit(None).cast("map<string,string>")
    assert one(spark, fn.resolve_args(defaults, none)) == {"a": "1", "b": "2"}


def test_supports(spark):
    assert one(spark, fn.supports(F.array(F.lit("linux")), "linux")) is True
    assert one(spark, fn.supports(F.array(F.lit("windows")), "linux")) is False
    assert one(spark, fn.supports(F.lit(None).cast("array<string>"), "linux")) is False


def test_matches_attrs(spark):
    row = F.create_map(F.lit("k"), F.lit("9"), F.lit("n"), F.lit(None).cast("string"))
    match = lambda *pairs: one(spark, fn.matches_attrs(F.create_map(*map(F.lit, pairs)), row))
    assert match("k", "9") is True
    assert match("k", "8") is False
    assert match("x", "9") is False


def test_lines(spark):
    text = "a b\r\nc\x0bd\x85e \tf\x1fg \n\n"
    assert one(spark, fn.plain_lines(F.lit(text))) == ["a b", "c", "d", "e", "f g", "", ""]
    assert one(spark, fn.strip_space(F.lit("  a b\n\x1c"))) == "a b"
