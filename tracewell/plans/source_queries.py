"""Sources and sinks. What has no table is written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas, sources
from tracewell.operators.metrics import findings_document
from tracewell.plans.registry import query, table
from tracewell.session import work_path


@query(
    "src01_plugin_rows",
    """
    WITH docs AS (
      SELECT event_id, json_extract('{"rows":[' || props || ',3]}', '$.rows[*]') AS elems FROM events
    ), rows AS (
      SELECT event_id, unnest(elems) AS elem, unnest(range(len(elems))) AS pos FROM docs
    )
    SELECT event_id, CAST(pos AS INTEGER) AS pos, CAST(json_extract_string(elem, '$.k') AS BIGINT) AS k
    FROM rows WHERE json_type(elem) = 'OBJECT'
    """,
)
def plugin_rows(spark, folder):
    payload = F.concat(F.lit('{"rows":['), F.col("props"), F.lit(",3]}"))
    docs = table(spark, folder, "events", spread=True).select("event_id", payload.alias("payload"))
    return sources.plugin_rows(docs, "payload").select(
        "event_id", "pos", F.col("attrs")["k"].cast("bigint").alias("k")
    )


@query(
    "src01_plugin_quarantine",
    """
    SELECT event_id, payload FROM (
      SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 2) ELSE props END AS payload
      FROM events
    ) WHERE NOT json_valid(payload)
    """,
)
def plugin_quarantine(spark, folder):
    payload = F.when(F.col("event_type") == "error", F.expr("substr(props, 2)")).otherwise(
        F.col("props")
    )
    docs = table(spark, folder, "events").select("event_id", payload.alias("payload"))
    return sources.plugin_quarantine(docs, "payload")


def _ioc(id_, kind, **attributes):
    """One indicator as its JSON document holds it."""
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        id_.alias("id"),
        F.lit(kind).alias("type"),
        F.create_map(*pairs).alias("attributes"),
        F.array(F.lit("disk_list")).alias("sources"),
    )


def _truth_documents(spark, folder):
    """A ground-truth document per benchmark item; short texts had no result, and the
    shortest were cleanup runs."""
    item = F.col("item_id").cast("string")
    name = lambda kind: F.concat(F.lit(f"{kind}-"), item)
    iocs = F.array(
        _ioc(name("text"), "file", content_contains=F.col("text")),
        _ioc(name("size"), "file", path=name("/items/"), size_bytes=F.length("text")),
        _ioc(name("gone"), "file", path=name("/gone/"), exists=F.lit(False)),
    )
    return table(spark, folder, "benchmark").select(
        F.concat(F.lit("run-"), item).alias("run_id"),
        F.concat(F.lit("scenario-"), item).alias("scenario_id"),
        iocs.alias("iocs"),
        F.when(F.length("text") >= 150, F.struct(name("test").alias("name"))).alias("result"),
        (F.length("text") < 120).alias("cleanup"),
    )


@query(
    "src02_ground_truth",
    """
    WITH kept AS (SELECT * FROM benchmark)
    SELECT 'scenario-' || item_id AS scenario_id, 0 AS ordinal, 'text-' || item_id AS ioc_id,
           CAST(NULL AS VARCHAR) AS path, text AS content_contains,
           CAST(NULL AS BIGINT) AS size_bytes, CAST(NULL AS BOOLEAN) AS "exists" FROM kept
    UNION ALL
    SELECT 'scenario-' || item_id, 1, 'size-' || item_id, '/items/-' || item_id, NULL,
           length(text), NULL FROM kept
    UNION ALL
    SELECT 'scenario-' || item_id, 2, 'gone-' || item_id, '/gone/-' || item_id, NULL, NULL, false
    FROM kept
    """,
)
def ground_truth(spark, folder):
    path = work_path(spark, "ground-truth")
    sources.write_ground_truth(_truth_documents(spark, folder), path, partition_by=())
    docs = sources.read_ground_truth(spark, path, multi_line=False)
    return sources.ground_truth_iocs(docs).select(
        "scenario_id", "ordinal", "ioc_id", "path", "content_contains", "size_bytes", "exists"
    )


@query(
    "src02_quarantine",
    """
    SELECT 'scenario-' || item_id AS scenario_id, item_id % 3 = 0 AS broken,
           CASE WHEN item_id % 3 <> 0 THEN 3 END AS n_iocs FROM benchmark
    """,
)
def ground_truth_quarantine(spark, folder):
    """Documents of which every third is cut off."""
    path = work_path(spark, "ground-truth-broken")
    docs = _truth_documents(spark, folder).select("scenario_id", "iocs")
    text = F.to_json(F.struct("*"))
    cut = F.substring_index("scenario_id", "-", -1).cast("bigint") % 3 == 0
    docs.select(F.when(cut, F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text).alias("value")).write.text(path)
    good = sources.read_ground_truth(spark, path, multi_line=False, mode="quarantine")
    bad = sources.read_quarantine(spark, path, schemas.GROUND_TRUTH, multi_line=False)
    name = F.regexp_extract("text", '"scenario_id":"([^"]*)"', 1)
    return good.select("scenario_id", F.lit(False).alias("broken"), F.size("iocs").alias("n_iocs")).union(
        bad.select(name, F.lit(True), F.lit(None).cast("int"))
    )


@query(
    "src02_verdicts",
    """
    SELECT CASE WHEN verdict IS NULL THEN 'taken' ELSE 'quarantined' END AS mode, item, verdict,
           CASE WHEN verdict IS NULL THEN 3 END AS n_iocs FROM (
      SELECT 'item-' || item_id AS item,
             CASE item_id % 6 WHEN 1 THEN 'broken' WHEN 2 THEN 'trailing' WHEN 3 THEN 'trailing'
                              WHEN 4 THEN 'empty' WHEN 5 THEN 'shape' END AS verdict
      FROM benchmark)
    """,
)
def ground_truth_verdicts(spark, folder):
    """One file for each document: good, cut off, with a line after it, twice, blank, a list."""
    path = work_path(spark, "ground-truth-files")
    docs = _truth_documents(spark, folder).select("scenario_id", "iocs")
    text, name = F.to_json(F.struct("*")), F.substring_index("scenario_id", "-", -1)
    kind = name.cast("bigint") % 6
    value = (
        F.when(kind == 1, F.substr(text, F.lit(1), F.length(text) - 9)).when(kind == 2, F.concat(text, F.lit("\n-- end")))
        .when(kind == 3, F.concat(text, F.lit("\n"), text)).when(kind == 4, F.lit(" "))
        .when(kind == 5, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    )
    files = docs.select(F.concat(F.lit("item-"), name).alias("item"), value.alias("value"))
    files.write.partitionBy("item").text(path)
    good = sources.read_ground_truth(spark, path, mode="quarantine")
    bad = sources.read_quarantine(spark, path, schemas.GROUND_TRUTH)
    return good.select(
        F.lit("taken").alias("mode"), "item", F.lit(None).cast("string").alias("verdict"), F.size("iocs").alias("n_iocs")
    ).union(
        bad.select(F.lit("quarantined"), F.regexp_extract("path", "/item=([^/]+)/", 1), "verdict", F.lit(None).cast("int"))
    )


@query(
    "snk03_ground_truth",
    """
    SELECT 'run-' || item_id AS run_id, 'scenario-' || item_id AS scenario_id,
           CASE WHEN length(text) >= 150 THEN 'test-' || item_id END AS result_name
    FROM benchmark WHERE length(text) >= 120
    """,
)
def ground_truth_sink(spark, folder):
    """Written in two parts to one path: the second leaves the first as it is."""
    path = work_path(spark, "ground-truth-runs")
    docs = _truth_documents(spark, folder)
    odd = F.pmod(F.hash("run_id"), F.lit(2)) == 1
    for part in (docs.where(odd), docs.where(~odd)):
        sources.write_ground_truth(part, path, cleanup="cleanup")
    return spark.read.schema(
        "run_id STRING, scenario_id STRING, result STRUCT<name: STRING>"
    ).json(path).select("run_id", "scenario_id", F.col("result.name").alias("result_name"))


def _scenario_documents(spark, folder):
    """A scenario document per part, with two steps and one indicator."""
    key = F.col("p_partkey").cast("string")
    name = lambda kind: F.concat(F.lit(f"{kind}-"), key)
    step = lambda kind, phase, levels, iocs: F.struct(
        name(kind).alias("id"),
        F.col("p_type").alias("description"),
        F.concat(F.lit("use {{name}} of "), F.col("p_brand")).alias("command"),
        F.lit(phase).alias("phase"),
        F.array(*map(F.lit, levels)).alias("evasion_levels"),
        iocs.alias("expected_iocs"),
    )
    path = F.concat(F.lit("/{{folder}}/{{name}}/"), F.col("p_brand"))
    ioc = _ioc(name("ioc"), "file", path=path, size_bytes=F.col("p_size"))
    none = F.filter(F.array(ioc), lambda _: F.lit(False))
    return table(spark, folder, "part").select(
        name("scenario").alias("id"),
        F.create_map(F.lit("name"), F.col("p_name")).alias("defaults"),
        F.array(
            step("look", "reconnaissance", ["none", "normal", "high"], none),
            step("hide", "evasion", ["normal", "high"], F.array(ioc)),
        ).alias("steps"),
        F.struct(F.array(ioc).alias("iocs")).alias("ground_truth"),
    )


def _scenarios(spark, folder):
    path = work_path(spark, "scenarios")
    _scenario_documents(spark, folder).write.json(path)
    return sources.read_scenarios(spark, path, multi_line=False)


@query(
    "src03_scenario_steps",
    """
    SELECT 'scenario-' || p_partkey AS scenario_id, o AS ordinal,
           (CASE o WHEN 0 THEN 'look-' ELSE 'hide-' END) || p_partkey AS step_id,
           CASE o WHEN 0 THEN 'reconnaissance' ELSE 'evasion' END AS phase,
           'use ' || p_name || ' of ' || p_brand AS command,
           CASE o WHEN 0 THEN 3 ELSE 2 END AS n_levels, o AS n_iocs
    FROM part, (VALUES (0), (1)) AS t(o)
    """,
)
def scenario_steps(spark, folder):
    from tracewell.functions import render_template

    steps, _ = _scenarios(spark, folder)
    return steps.select(
        "scenario_id",
        "ordinal",
        "step_id",
        "phase",
        render_template(F.col("command"), F.col("defaults"), "braces").alias("command"),
        F.size("evasion_levels").alias("n_levels"),
        F.size("expected_iocs").alias("n_iocs"),
    )


@query(
    "src03_scenario_iocs",
    """
    SELECT 'scenario-' || p_partkey AS scenario_id, 'ioc-' || p_partkey AS ioc_id, 'file' AS type,
           '/{{folder}}/' || p_name || '/' || p_brand AS path, CAST(p_size AS BIGINT) AS size_bytes FROM part
    """,
)
def scenario_iocs(spark, folder):
    _, iocs = _scenarios(spark, folder)
    return iocs.select("scenario_id", "ioc_id", "type", "path", "size_bytes")


@query(
    "src04_catalog",
    """
    SELECT 'T' || p_partkey AS technique_id, o AS ordinal, p_partkey || '-' || o AS guid,
           p_name AS name, CASE o WHEN 0 THEN 'sh' ELSE 'bash' END AS executor,
           o = 1 AND p_size > 25 AS elevation_required,
           CASE o WHEN 0 THEN CAST(p_size AS VARCHAR) END AS default_size,
           CASE o WHEN 0 THEN 2 ELSE 1 END AS n_platforms
    FROM part, (VALUES (0), (1)) AS t(o)
    """,
)
def catalog(spark, folder):
    text = F.format_string(
        "attack_technique: T%d\n"
        "display_name: '%s'\n"
        "atomic_tests:\n"
        "- name:  %s\n"
        "  auto_generated_guid: %d-0\n"
        "  supported_platforms: [linux, macos]\n"
        "  input_arguments:\n"
        "    size:\n"
        "      description: size\n"
        "      type: integer\n"
        "      default: %d\n"
        "  executor:\n"
        "    name: sh\n"
        "    command: |\n"
        "      echo #{size}\n"
        "- name: %s\n"
        "  auto_generated_guid: %d-1\n"
        "  supported_platforms:\n"
        "  - linux\n"
        "  executor: {name: bash, command: 'true', elevation_required: %s}\n",
        *[F.col(c) for c in ("p_partkey", "p_brand", "p_name", "p_partkey", "p_size", "p_name", "p_partkey")],
        F.when(F.col("p_size") > 25, "true").otherwise("false"),
    )
    docs = table(spark, folder, "part", spread=True).select(text.alias("text"))
    return sources.catalog_tests(docs, "text").select(
        "technique_id",
        "ordinal",
        "guid",
        "name",
        "executor",
        "elevation_required",
        F.col("argument_defaults")["size"].alias("default_size"),
        F.size("supported_platforms").alias("n_platforms"),
    )


@query(
    "src05_registry",
    """
    SELECT 'run-' || c_custkey AS key, 'T' || c_nationkey AS technique_id, '' AS test_guid,
           false AS cleanup FROM customer
    UNION ALL
    SELECT 'one-' || c_custkey, 'T' || c_nationkey, c_mktsegment, c_acctbal > 0 FROM customer
    """,
)
def registry(spark, folder):
    text = F.format_string(
        "# scenarios of one customer\n"
        'run-%d:\n  technique_id: T%d\n  test_guid: ""   # all tests\n'
        "one-%d:\n  technique_id: T%d\n  test_guid: %s\n  cleanup: %s\n",
        *[F.col(c) for c in ("c_custkey", "c_nationkey", "c_custkey", "c_nationkey", "c_mktsegment")],
        F.when(F.col("c_acctbal") > 0, "true").otherwise("false"),
    )
    docs = table(spark, folder, "customer", spread=True).select(text.alias("text"))
    return sources.registry_rows(docs, "text")


@query(
    "src06_profiles",
    """
    SELECT 'distro-' || s_nationkey AS distro_id, s_name AS os_variant,
           'https://images.example.org/' || s_suppkey || '/disk.img' AS url,
           CASE WHEN s_acctbal > 0 THEN 'disk-' || s_suppkey || '.img' END AS filename,
           CASE WHEN s_acctbal > 0 THEN 'sha256' ELSE 'sha512' END AS checksum_algo
    FROM supplier
    """,
)
def profiles(spark, folder):
    named = F.col("s_acctbal") > 0
    text = F.concat(
        F.format_string(
            "distro_id: distro-%d\nos_variant: %s   # name\nimage:\n"
            "  url: https://images.example.org/%d/disk.img\n",
            "s_nationkey", "s_name", "s_suppkey",
        ),
        F.when(named, F.format_string("  filename: disk-%d.img\n", "s_suppkey")).otherwise(""),
        F.when(named, "  checksum_algo: sha256\n").otherwise("  checksum_algo: sha512\n"),
    )
    docs = table(spark, folder, "supplier").select(text.alias("text"))
    return sources.profile_rows(docs, "text").select(
        "distro_id", "os_variant", "url", "filename", "checksum_algo"
    )


@query(
    "src07_checksum_lines",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
      FROM (SELECT doc_id,
              string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l
            FROM documents)
    ), words AS (
      SELECT doc_id, line_no, list_filter(string_split_regex(line,
        '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
        lambda w: w <> '') AS w FROM lines
    )
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, lower(w[1]) AS hash,
           ltrim(ltrim(w[len(w)], './'), '*') AS file_name
    FROM words WHERE len(w) >= 2
    """,
)
def checksum_lines(spark, folder):
    docs = table(spark, folder, "documents", spread=True).select("doc_id", "text")
    return sources.checksum_lines(docs, "text")


def _manifests(spark, folder):
    """A manifest per order; the memory image is taken a minute before the disk."""
    key = F.col("o_orderkey").cast("string")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    no_long = F.lit(None).cast("bigint")
    taken = (F.col("o_custkey") * 60).cast("double")

    def image(kind, tool, at, size, segments, virtual, total):
        return F.struct(
            F.concat(F.lit("dumps/"), key, F.lit(f"/{kind}")).alias("path"),
            F.lit(tool).alias("tool"),
            F.sha2(F.concat(key, F.lit(kind)), 256).alias("sha256"),
            size.alias("size_bytes"),
            at.alias("timestamp"),
            segments.alias("segments"),
            (F.col("o_custkey") * 0.5).alias("acquisition_seconds"),
            virtual.alias("virtual_size_bytes"),
            total.alias("ewf_size_bytes"),
        )

    names = F.array(*[F.concat(key, F.lit(f".E0{i}")) for i in (1, 2)])
    return table(spark, folder, "orders").select(
        F.concat(F.lit("run-"), key).alias("scenario_id"),
        taken.alias("created_at"),
        image(
            "memory", "dump", taken, cents, F.lit(None).cast("array<string>"), no_long, no_long
        ).alias("memory_image"),
        image("disk", "convert", taken + 60, cents, names, cents * 4, cents * 2).alias("disk_image"),
    )


def _read_manifests(spark, folder):
    """Written in two parts, by a coarse column as runs are many, and read as one."""
    path = work_path(spark, "manifests")
    manifests = _manifests(spark, folder).withColumn("part", F.pmod(F.hash("scenario_id"), F.lit(4)))
    for part in (manifests.where("part < 2"), manifests.where("part >= 2")):
        sources.write_manifests(part, path, partition_by=("part",))
    return sources.read_manifests(spark, path, multi_line=False)


@query(
    "src08_manifest_images",
    """
    WITH o AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
    SELECT 'run-' || o_orderkey AS run_id, 'memory' AS kind, 'dumps/' || o_orderkey || '/memory' AS path,
           cents AS size_bytes, CAST(o_custkey * 60 AS DOUBLE) AS timestamp,
           CAST(NULL AS VARCHAR) AS segment_names, CAST(NULL AS BIGINT) AS ewf_size_bytes, 'dump' AS tool,
           sha256(o_orderkey || 'memory') AS sha256, CAST(o_custkey * 0.5 AS DOUBLE) AS acquisition_seconds,
           CAST(NULL AS BIGINT) AS virtual_size_bytes FROM o
    UNION ALL
    SELECT 'run-' || o_orderkey, 'disk', 'dumps/' || o_orderkey || '/disk', cents,
           CAST(o_custkey * 60 + 60 AS DOUBLE), o_orderkey || '.E01,' || o_orderkey || '.E02', cents * 2, 'convert',
           sha256(o_orderkey || 'disk'), CAST(o_custkey * 0.5 AS DOUBLE), cents * 4
    FROM o
    """,
)
def manifest_images(spark, folder):
    _, images = _read_manifests(spark, folder)
    return images.select(
        "run_id",
        "kind",
        "path",
        "size_bytes",
        "timestamp",
        F.when(F.col("segments").isNotNull(), F.array_join("segments", ",")).alias("segment_names"),
        "ewf_size_bytes",
        "tool",
        "sha256",
        "acquisition_seconds",
        "virtual_size_bytes",
    )


@query(
    "snk02_manifests",
    """
    SELECT 'run-' || o_orderkey AS run_id, CAST(o_custkey * 60 AS DOUBLE) AS created_at FROM orders
    """,
)
def manifest_runs(spark, folder):
    runs, _ = _read_manifests(spark, folder)
    return runs


@query(
    "src09_run_log",
    r"""
    WITH lines AS (
      SELECT conv_id, turn, unnest(l) AS line, unnest(range(len(l))) AS n, guid FROM (
        SELECT conv_id, turn, string_split(text, chr(10)) AS l, string_split(text, ' ')[1] AS guid
        FROM conversations)
    ), tails AS (
      SELECT conv_id, turn, n, trim(substr(line, length(guid) + 1)) AS rest
      FROM (SELECT * REPLACE (trim(line) AS line) FROM lines)
      WHERE starts_with(line, guid) AND line <> ''
    ), firsts AS (
      SELECT conv_id, turn, arg_min(rest, n) AS first_rest FROM tails WHERE rest <> '' GROUP BY ALL
    )
    SELECT c.conv_id, c.turn, f.first_rest, c.role AS logged_role, c.turn AS logged_turn
    FROM conversations c LEFT JOIN firsts f USING (conv_id, turn)
    """,
)
def run_log(spark, folder):
    log = F.concat(
        F.col("text"),
        F.format_string('\nconv-%d\n  conv-%d {"role":"%s",', "conv_id", "conv_id", "role"),
        F.format_string('"turn":%d}\nconv-%d {"turn":-1}', "turn", "conv_id"),
    )
    logs = table(spark, folder, "conversations", spread=True).select(
        "conv_id",
        "turn",
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("guid"),
        log.alias("stdout"),
        sources.run_log_payload(F.col("text"), F.element_at(F.split("text", " "), 1)).alias(
            "first_rest"
        ),
    )
    field = lambda name, kind: F.try_variant_get("result", f"$.{name}", kind)
    return sources.parse_run_log(logs, "stdout", "guid").select(
        "conv_id",
        "turn",
        "first_rest",
        field("role", "string").alias("logged_role"),
        field("turn", "bigint").alias("logged_turn"),
    )


@query(
    "snk01_findings",
    """
    SELECT 'doc-' || (doc_id // 10) AS run_id, source AS scenario_id, 'ioc-' || doc_id AS ioc_id,
           lang AS type, contains(text, '!!') AS matched
    FROM documents
    """,
)
def findings_sink(spark, folder):
    key = F.col("doc_id").cast("string")
    findings = table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.expr("doc_id div 10").cast("string")).alias("run_id"),
        F.col("source").alias("scenario_id"),
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("ioc-"), key).alias("ioc_id"),
        F.col("lang").alias("type"),
        F.contains("text", F.lit("!!")).alias("matched"),
    )
    path = work_path(spark, "findings")
    # A folder per scenario: there are as many runs as a tenth of the documents.
    sources.write_findings(findings_document(findings), path, partition_by=("scenario_id",))
    documents = spark.read.schema(schemas.FINDINGS).json(path)
    return documents.select("run_id", "scenario_id", F.explode("findings").alias("f")).select(
        "run_id", "scenario_id", "f.*"
    )


def _written_files(files, name):
    """Writes ``content`` to ``path`` below a new folder, and returns the folder."""
    from pyarrow import fs

    root = work_path(files.sparkSession, name)

    def write(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                store, inner = fs.FileSystem.from_uri(f"{root}/{path}")
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(inner) as out:
                    out.write(content.encode())
            yield batch[["path"]]

    files.select("path", "content").mapInPandas(write, "path STRING").write.format("noop").mode("overwrite").save()
    return root


@query(
    "src10_segments",
    """
    SELECT 'nation-' || s_nationkey || '/run-' || s_suppkey || '/disk' AS image, 'E0' || i AS ending,
           CASE WHEN i = 3 THEN 0 ELSE i * length(s_comment) END AS size_bytes
    FROM (SELECT s_nationkey, s_suppkey, 'x' || s_name AS s_comment FROM supplier), range(1, 4) AS t(i)
    WHERE i <= s_suppkey % 3 + 1
    """,
)
def segments(spark, folder):
    """Images of up to three segments in a tree of folders, the third one empty, with other files beside them."""
    text = F.concat(F.lit("x"), "s_name")
    base = F.concat(
        F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit("/run-"), F.col("s_suppkey").cast("string"), F.lit("/disk")
    )
    n = F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("n")
    files = table(spark, folder, "supplier").select(base.alias("base"), text.alias("text"), n).select(
        F.concat("base", F.when(F.col("n") == 0, ".log").otherwise(F.concat(F.lit(".E0"), F.col("n").cast("string")))).alias("path"),
        F.when(F.col("n") == 3, "").otherwise(F.repeat("text", F.col("n"))).alias("content"),
    )
    found = sources.list_segments(spark, _written_files(files, "segments"))
    return found.select(
        F.regexp_extract("image_id", "(nation-[^/]+/run-[^/]+/disk)$", 1).alias("image"),
        F.substring_index("path", ".", -1).alias("ending"),
        "size_bytes",
    )


@query(
    "src11_symbols",
    """
    SELECT 'family' || s_nationkey AS family, '5.' || s_suppkey || '_x' AS kernel,
           'family' || s_nationkey || '_5.' || s_suppkey || '_x.json' AS file_name
    FROM supplier WHERE s_suppkey % 4 <> 0
    """,
)
def symbols(spark, folder):
    """Symbol files, every fourth with an ending that none has."""
    ending = F.when(F.col("s_suppkey") % 4 == 0, ".txt").otherwise(".json")
    path = F.concat(
        F.lit("family"), F.col("s_nationkey").cast("string"), F.lit("_5."), F.col("s_suppkey").cast("string"), F.lit("_x"), ending
    )
    files = table(spark, folder, "supplier").select(path.alias("path"), F.lit("{}").alias("content"))
    return sources.list_symbols(spark, _written_files(files, "symbols"))
