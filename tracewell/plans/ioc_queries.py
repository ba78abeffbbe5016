"""Indicator matching over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import ioc
from tracewell.operators.metrics import findings_document, outcome_metrics
from tracewell.plans.registry import query, table
from tracewell.session import work_path
from tracewell.sources import scenario_iocs, scenario_steps

NO_TEXT = "CAST(NULL AS STRING)"

# Items per scenario; a findings document is this long, times the indicators of an item.
ITEMS_PER_SCENARIO = 16


def _text(column):
    return (F.col(column) if isinstance(column, str) else column).cast("string")


# --- files: line items as entries, parts as indicators -----------------------


def _part_iocs(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_type").alias("scenario_id"),
        F.concat(F.lit("part-"), _text("p_partkey")).alias("ioc_id"),
        F.concat(F.lit("/parts/"), _text("p_partkey")).alias("path"),
        F.when(F.col("p_size") <= 25, F.col("p_size").cast("bigint")).alias("size_bytes"),
        F.when(F.col("p_size") > 10, F.lit("NF")).alias("content_contains"),
    )


def _lineitem_entries(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("supplier-"), _text("l_suppkey")).alias("run_id"),
        F.concat(F.lit("/parts/"), _text("l_partkey")).alias("path"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
        F.concat(F.col("l_returnflag"), F.lit(":"), F.col("l_returnflag"), F.col("l_linestatus")).alias(
            "content"
        ),
    )


JN01 = """
    SELECT DISTINCT 'supplier-' || l_suppkey AS run_id, p_type AS scenario_id,
           'part-' || p_partkey AS ioc_id
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE (p_size > 25 OR CAST(l_quantity AS BIGINT) = p_size)
      AND (p_size <= 10 OR contains(l_returnflag || ':' || l_returnflag || l_linestatus, 'NF'))
    """


@query("jn01_file_iocs", JN01)
def file_iocs(spark, folder):
    return ioc.match_file_iocs(_lineitem_entries(spark, folder), _part_iocs(spark, folder))


@query("jn01_file_iocs_shuffled", JN01)
def file_iocs_shuffled(spark, folder):
    """The way taken when the indicators are too many to broadcast."""
    return ioc.match_file_iocs(
        _lineitem_entries(spark, folder),
        _part_iocs(spark, folder),
        limits=ioc.Limits(broadcast_rows=0, rows_per_task=500),
    )


# --- processes: events as tool rows, benchmark items as indicators -------------


def _event_rows(spark, folder):
    props = F.from_json("props", "map<string,string>")
    more = F.create_map(F.lit("user"), _text("user_id"))
    return table(spark, folder, "events", spread=True).select(
        F.concat(F.lit("user-"), _text("user_id")).alias("run_id"),
        F.col("event_type").alias("plugin"),
        F.map_concat(props, more).alias("attrs"),
    )


def _event_iocs(spark, folder):
    """Per item: one value, a pair of values, and a field the rows lack."""
    item = F.col("item_id")
    k = (item % 100).cast("string")
    user = (item % 150).cast("string")
    absent = F.lit(None).cast("string")
    wanted = lambda kind, *pairs: F.struct(
        F.lit(kind).alias("kind"), F.create_map(*pairs).alias("attrs")
    )
    kinds = F.array(
        wanted("one", F.lit("k"), k),
        wanted("two", F.lit("k"), k, F.lit("user"), user),
        wanted("none", F.lit("PID"), absent),
    )
    plugins = F.array(*map(F.lit, ["click", "view", "error", "signup", "purchase"]))
    return (
        table(spark, folder, "benchmark")
        .select("item_id", F.explode(kinds).alias("want"))
        .select(
            F.lit("events").alias("scenario_id"),
            F.concat("want.kind", F.lit("-"), _text("item_id")).alias("ioc_id"),
            F.element_at(plugins, (F.col("item_id") % 5 + 1).cast("int")).alias("plugin"),
            F.col("want.attrs").alias("attrs"),
        )
    )


JN02 = """
    WITH wanted AS (
      SELECT item_id, item_id % 100 AS k, item_id % 150 AS u,
             (['click', 'view', 'error', 'signup', 'purchase'])[item_id % 5 + 1] AS plugin
      FROM benchmark
    ), rows AS (
      SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    )
    SELECT DISTINCT 'user-' || user_id AS run_id, 'events' AS scenario_id, 'one-' || item_id AS ioc_id
    FROM rows r JOIN wanted w ON event_type = plugin AND r.k = w.k
    UNION ALL
    SELECT DISTINCT 'user-' || user_id, 'events', 'two-' || item_id
    FROM rows r JOIN wanted w ON event_type = plugin AND r.k = w.k AND user_id = u
    UNION ALL
    SELECT DISTINCT 'user-' || user_id, 'events', 'none-' || item_id
    FROM rows r JOIN wanted w ON event_type = plugin
    """


@query("jn02_process_iocs", JN02)
def process_iocs(spark, folder):
    return ioc.match_process_iocs(_event_rows(spark, folder), _event_iocs(spark, folder))


@query("jn02_process_iocs_shuffled", JN02)
def process_iocs_shuffled(spark, folder):
    return ioc.match_process_iocs(
        _event_rows(spark, folder),
        _event_iocs(spark, folder),
        limits=ioc.Limits(broadcast_rows=0, rows_per_task=500),
    )


# --- absence: orders as entries, customers as runs ------------------------------


@query(
    "jn03_absent_iocs",
    """
    WITH o AS (SELECT o_custkey, o_orderpriority, o_orderstatus, c_mktsegment
               FROM orders JOIN customer ON o_custkey = c_custkey),
    iocs AS (SELECT DISTINCT c_mktsegment, o_orderpriority FROM o),
    grid AS (SELECT c_custkey, c_mktsegment, o_orderpriority FROM customer JOIN iocs USING (c_mktsegment)),
    looked AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')),
    found AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
    SELECT 'customer-' || c_custkey AS run_id, c_mktsegment AS scenario_id, g.o_orderpriority AS ioc_id,
           l.o_custkey IS NOT NULL AS assessed,
           l.o_custkey IS NOT NULL AND f.o_custkey IS NULL AS matched
    FROM grid g LEFT JOIN looked l ON c_custkey = l.o_custkey
    LEFT JOIN found f ON c_custkey = f.o_custkey AND g.o_orderpriority = f.o_orderpriority
    """,
)
def absent_iocs(spark, folder):
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    run = lambda key: F.concat(F.lit("customer-"), _text(key)).alias("run_id")
    iocs = (
        orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
        .distinct()
        .join(customers, "c_custkey")
        .select("c_mktsegment", "o_orderpriority")
        .distinct()
    )
    expected = customers.join(iocs, "c_mktsegment").select(
        run("c_custkey"),
        F.col("c_mktsegment").alias("scenario_id"),
        F.col("o_orderpriority").alias("ioc_id"),
        F.col("o_orderpriority").alias("path"),
        F.lit(False).alias("exists"),
        F.array(F.lit("F"), F.lit("P")).alias("sources"),
    )
    entries = orders.select(
        run("o_custkey"),
        F.col("o_orderpriority").alias("path"),
        F.col("o_orderstatus").alias("source"),
    )
    return ioc.match_absent_iocs(entries, expected)


# --- content: documents as entries, benchmark texts as markers -------------------


def _content(spark, folder, **limits):
    return ioc.content_hits(
        table(spark, folder, "documents", spread=True),
        table(spark, folder, "benchmark").withColumnRenamed("text", "marker"),
        content="text",
        marker="marker",
        keep=["doc_id"],
        limits=ioc.Limits(**limits),
    )


JN04 = """
    SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
    """


@query("jn04_content_iocs", JN04)
def content_iocs(spark, folder):
    return _content(spark, folder)


@query("jn04_content_iocs_by_word", JN04)
def content_iocs_by_word(spark, folder):
    """The way taken for more markers than a text is searched for one by one: by their rarest grams."""
    return _content(spark, folder, scan_markers=0)


@query("jn04_content_iocs_shuffled", JN04)
def content_iocs_shuffled(spark, folder):
    """The way taken for more markers than can be broadcast."""
    return _content(spark, folder, scan_markers=0, broadcast_rows=1, rows_per_task=500)


JN04_SHORT = """
    WITH markers AS (
      SELECT item_id, 'word' AS kind, split_part(text, ' ', 1) AS marker FROM benchmark
      UNION ALL SELECT item_id, 'two', split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) FROM benchmark
      UNION ALL SELECT item_id, 'part', substr(text, 3 + item_id % 20, 3 + item_id % 8) FROM benchmark
    )
    SELECT d.doc_id, m.item_id, m.kind FROM documents d JOIN markers m ON contains(d.text, m.marker)
    """


def _short_markers(spark, folder, **limits):
    """A word, two words, and a few characters from within: nothing with an inner word."""
    words = F.split("text", " ")
    kind = lambda name, marker: F.struct(F.lit(name).alias("kind"), marker.alias("marker"))
    part = F.substring(F.col("text"), (F.col("item_id") % 20 + 3).cast("int"), (F.col("item_id") % 8 + 3).cast("int"))
    kinds = F.array(
        kind("word", words[0]), kind("two", F.concat_ws(" ", words[1], words[2])), kind("part", part)
    )
    markers = table(spark, folder, "benchmark").select("item_id", F.explode(kinds).alias("m")).select("item_id", "m.*")
    documents = table(spark, folder, "documents", spread=True)
    return ioc.content_hits(
        documents, markers, content="text", marker="marker", keep=["doc_id"], limits=ioc.Limits(**limits)
    )


@query("jn04_content_iocs_short", JN04_SHORT)
def content_iocs_short(spark, folder):
    return _short_markers(spark, folder)


@query("jn04_content_iocs_short_shuffled", JN04_SHORT)
def content_iocs_short_shuffled(spark, folder):
    return _short_markers(spark, folder, scan_markers=0, broadcast_rows=1, rows_per_task=5000)


# --- detection -----------------------------------------------------------------------


def _scenario():
    return F.expr(f"CAST(item_id DIV {ITEMS_PER_SCENARIO} AS STRING)")


def _item_iocs(spark, folder):
    """An item's indicators.

    One of its text, one of a file that must not exist, one of a type nothing can
    match, one of a file that must exist, and one of a tool row.
    """
    item = _text("item_id")
    none = F.lit(None)
    plugins = F.array(*map(F.lit, ["click", "view", "error", "signup", "purchase"]))
    plugin = F.element_at(plugins, (F.col("item_id") % 5 + 1).cast("int"))
    attrs = F.create_map(F.lit("k"), (F.col("item_id") % 100).cast("string"))
    want = lambda n, kind, type_, path=none, text=none, exists=None, plugin=none, attrs=none: F.struct(
        (F.col("item_id") * 5 + n).alias("ordinal"),
        F.concat(F.lit(f"{kind}-"), item).alias("ioc_id"),
        F.lit(type_).alias("type"),
        path.cast("string").alias("path"),
        text.cast("string").alias("content_contains"),
        F.lit(exists).cast("boolean").alias("exists"),
        plugin.cast("string").alias("plugin"),
        attrs.cast("map<string,string>").alias("attrs"),
    )
    path = F.concat(F.lit("/doc/"), item)
    iocs = table(spark, folder, "benchmark").select(
        _scenario().alias("scenario_id"),
        F.explode(
            F.array(
                want(0, "text", "file", text=F.col("text")),
                want(1, "gone", "file", path, exists=False),
                want(2, "key", "registry"),
                want(3, "here", "file", path),
                want(4, "row", "process", plugin=plugin, attrs=attrs),
            )
        ).alias("ioc"),
    ).select("scenario_id", "ioc.*")
    return iocs.withColumns(
        {"size_bytes": F.lit(None).cast("bigint"), "sources": F.lit(None).cast("array<string>")}
    )


def _expected(spark, folder):
    """What each source was to show: every scenario of the benchmark."""
    items = table(spark, folder, "benchmark")
    last = items.agg(F.max("item_id")).scalar()
    scenarios = F.sequence(
        F.lit(0).cast("bigint"), F.floor(last / F.lit(ITEMS_PER_SCENARIO)).cast("bigint")
    )
    runs = (
        table(spark, folder, "documents")
        .select(F.col("source").alias("run_id"))
        .distinct()
        .select("run_id", F.explode(scenarios).alias("n"))
        .select("run_id", _text("n").alias("scenario_id"))
    )
    return runs.join(_item_iocs(spark, folder), "scenario_id")


def _document_entries(spark, folder):
    return table(spark, folder, "documents", spread=True).select(
        F.col("source").alias("run_id"),
        F.concat(F.lit("/doc/"), _text("doc_id")).alias("path"),
        F.col("n_chars").alias("size_bytes"),
        F.col("text").alias("content"),
        F.col("lang").alias("source"),
    )


def _source_rows(spark, folder):
    """Events as tool rows of the sources."""
    return table(spark, folder, "events", spread=True).select(
        F.concat(F.lit("src"), _text(F.col("user_id") % 20)).alias("run_id"),
        F.col("event_type").alias("plugin"),
        F.from_json("props", "map<string,string>").alias("attrs"),
    )


def detection(spark, folder):
    return ioc.detect_iocs(
        _expected(spark, folder),
        ioc.Evidence(_document_entries(spark, folder), _source_rows(spark, folder)),
        _item_iocs(spark, folder),
    )


FINDINGS = f"""
    items AS (SELECT item_id, CAST(item_id // {ITEMS_PER_SCENARIO} AS VARCHAR) AS scenario_id, text FROM benchmark),
    runs AS (SELECT DISTINCT source AS run_id FROM documents),
    hits AS (SELECT DISTINCT d.source AS run_id, b.item_id FROM documents d
             JOIN benchmark b ON contains(d.text, b.text)),
    rows AS (SELECT DISTINCT 'src' || (user_id % 20) AS run_id, event_type,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    docs AS (SELECT DISTINCT source AS run_id, doc_id FROM documents),
    grid AS (SELECT run_id, scenario_id, item_id,
             (['click', 'view', 'error', 'signup', 'purchase'])[item_id % 5 + 1] AS plugin FROM runs, items),
    findings AS (
      SELECT g.run_id, scenario_id, g.item_id * 5 AS ordinal, 'text-' || g.item_id AS ioc_id, 'file' AS type,
             h.item_id IS NOT NULL AS matched
      FROM grid g LEFT JOIN hits h ON h.run_id = g.run_id AND h.item_id = g.item_id
      UNION ALL
      SELECT g.run_id, scenario_id, item_id * 5 + 1, 'gone-' || item_id, 'file', d.doc_id IS NULL
      FROM grid g LEFT JOIN docs d ON d.run_id = g.run_id AND doc_id = item_id
      UNION ALL
      SELECT run_id, scenario_id, item_id * 5 + 2, 'key-' || item_id, 'registry', false FROM grid
      UNION ALL
      SELECT g.run_id, scenario_id, item_id * 5 + 3, 'here-' || item_id, 'file', d.doc_id IS NOT NULL
      FROM grid g LEFT JOIN docs d ON d.run_id = g.run_id AND doc_id = item_id
      UNION ALL
      SELECT g.run_id, scenario_id, item_id * 5 + 4, 'row-' || item_id, 'process', r.k IS NOT NULL
      FROM grid g LEFT JOIN rows r ON r.run_id = g.run_id AND event_type = plugin AND r.k = item_id % 100
    )"""


@query("jn05_detect_iocs", f"WITH {FINDINGS} SELECT * FROM findings")
def detect_iocs(spark, folder):
    return detection(spark, folder)


@query(
    "ag05_findings_document",
    f"""
    WITH {FINDINGS}
    SELECT run_id, scenario_id, count(*) AS n_findings,
           string_agg(ioc_id || ':' || type || ':' || matched, ' ' ORDER BY ordinal) AS findings
    FROM findings GROUP BY run_id, scenario_id
    """,
)
def document(spark, folder):
    documents = findings_document(detection(spark, folder))
    flat = F.transform(
        "findings",
        lambda f: F.concat_ws(":", f["ioc_id"], f["type"], f["matched"].cast("string")),
    )
    return documents.select(
        "run_id",
        "scenario_id",
        F.size("findings").cast("bigint").alias("n_findings"),
        F.array_join(flat, " ").alias("findings"),
    )


def _leveled_steps(spark, folder):
    """A step per part; small parts run at every level, large ones at the highest."""
    levels = (
        F.when(F.col("p_size") < 20, F.array(*map(F.lit, ["none", "normal", "high"])))
        .when(F.col("p_size") < 35, F.array(F.lit("normal"), F.lit("high")))
        .otherwise(F.array(F.lit("high")))
    )
    ids = F.array(*[F.struct(F.col(c).alias("id")) for c in ("p_name", "p_brand")])
    return table(spark, folder, "part").select(
        F.col("p_type").alias("scenario_id"),
        levels.alias("evasion_levels"),
        ids.alias("expected_iocs"),
    )


LEVELS = """
    WITH levels AS (
      SELECT p_type AS scenario_id, p_name, p_brand,
             unnest(CASE WHEN p_size < 20 THEN ['none', 'normal', 'high']
                         WHEN p_size < 35 THEN ['normal', 'high'] ELSE ['high'] END) AS level FROM part)
    """


@query(
    "jn10_expected_at_level",
    LEVELS
    + """
    SELECT scenario_id, level, p_name AS ioc_id FROM levels
    UNION SELECT scenario_id, level, p_brand FROM levels
    """,
)
def expected_at_level(spark, folder):
    return ioc.expected_at_level(_leveled_steps(spark, folder))


@query(
    "jn10_active_steps",
    LEVELS + "SELECT scenario_id, level, count(*) AS n_steps FROM levels GROUP BY ALL",
)
def active_steps(spark, folder):
    return ioc.active_steps(_leveled_steps(spark, folder))


# --- scenario documents to findings by level: parts as scenarios, line items as entries -------

LEVEL_NAMES = ("none", "normal", "high")


def _scenario_documents(spark, folder):
    """A scenario per part, as the JSON text of a document."""
    key = _text("p_partkey")
    none = F.lit(None).cast("string")
    levels = lambda *names: F.array(*map(F.lit, names))

    def indicator(id_, type_="file", sources=("F",), **attributes):
        given = {"path": none, "exists": none, "size_bytes": none, **attributes}
        named = F.create_map(*[x for n, v in given.items() for x in (F.lit(n), v.cast("string"))])
        return F.struct(
            F.concat(F.lit(f"{id_}-"), key).alias("id"), F.lit(type_).alias("type"),
            F.map_filter(named, lambda _, v: v.isNotNull()).alias("attributes"), levels(*sources).alias("sources"),
        )

    at = F.concat(F.lit("{{root}}/"), key)
    there = indicator("there", path=at, sources=("F", "O"))
    gone = indicator("gone", path=F.concat(at, F.lit("/{{leaf}}")), exists=F.lit("false"))
    size = indicator("size", path=at, size_bytes=F.col("p_size"), sources=("O",))
    extra = indicator("extra", "registry")
    hidden = F.when(F.col("p_size") < 20, levels("normal", "high")).otherwise(levels("high"))
    step = lambda n, where, *expects: F.struct(
        F.lit(f"step-{n}").alias("id"), where.alias("evasion_levels"), F.array(*expects).alias("expected_iocs")
    )
    defaults = F.create_map(F.lit("root"), F.lit("/parts"), F.lit("leaf"), F.lit("R"))
    document = F.struct(
        F.concat(F.lit("part-"), key).alias("id"), defaults.alias("defaults"),
        F.array(step(1, levels(*LEVEL_NAMES), there), step(2, hidden, gone), step(3, levels("high"), there, size)).alias("steps"),
        F.struct(F.array(there, gone, size, extra).alias("iocs")).alias("ground_truth"),
    )
    text = F.to_json(document)
    # Parsed once and written, as each step that reads the documents would parse them anew.
    path = work_path(spark, "scenarios")
    table(spark, folder, "part", spread=True).select(F.from_json(text, schemas.SCENARIO).alias("doc")).select("doc.*").write.parquet(path)
    return spark.read.schema(schemas.SCENARIO).parquet(path)


def _findings_at_level(spark, folder):
    documents = _scenario_documents(spark, folder)
    grid = ioc.level_grid(scenario_steps(documents), scenario_iocs(documents))
    run = lambda part, level: F.concat(F.lit("run-"), part.cast("string"), F.lit("-"), level)
    names = F.array(*map(F.lit, LEVEL_NAMES))
    runs = (
        table(spark, folder, "part").select("p_partkey", F.explode(names).alias("level"))
        .select(
            run(F.col("p_partkey"), F.col("level")).alias("run_id"),
            F.concat(F.lit("part-"), _text("p_partkey")).alias("scenario_id"), "level",
        )
    )
    leaf = F.when(F.col("l_returnflag") == "R", "/R").otherwise("")
    entries = table(spark, folder, "lineitem").select(
        run(F.col("l_partkey"), F.element_at(names, (F.col("l_orderkey") % 3 + 1).cast("int"))).alias("run_id"),
        F.concat(F.lit("/parts/"), _text("l_partkey"), leaf).alias("path"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
        F.col("l_linestatus").alias("source"),
    )
    return ioc.findings_at_level(runs, grid, ioc.Evidence(entries))


AT_LEVEL = """
    WITH runs AS (
      SELECT p_partkey AS k, p_size AS size, unnest(['none', 'normal', 'high']) AS level FROM part
    ), entries AS (
      SELECT l_partkey AS k, (['none', 'normal', 'high'])[l_orderkey % 3 + 1] AS level, l_returnflag = 'R' AS leaf,
             CAST(l_quantity AS BIGINT) AS n, l_linestatus AS source FROM lineitem
    ), told AS (
      SELECT r.k, r.size, r.level, coalesce(bool_or(NOT leaf), false) AS there, coalesce(bool_or(leaf), false) AS leaf,
             coalesce(bool_or(NOT leaf AND n = r.size), false) AS sized,
             coalesce(bool_or(source = 'F'), false) AS f, coalesce(bool_or(source = 'O'), false) AS o
      FROM runs r LEFT JOIN entries e ON e.k = r.k AND e.level = r.level GROUP BY r.k, r.size, r.level
    ), grid AS (
      SELECT k, level, 'there' AS ioc, 'expected' AS presence, there AS matched, f OR o AS assessed FROM told
      UNION ALL
      SELECT k, level, 'gone', CASE WHEN level = 'high' OR (level = 'normal' AND size < 20) THEN 'expected' ELSE 'not_expected' END,
             f AND NOT leaf, f FROM told
      UNION ALL
      SELECT k, level, 'size', CASE WHEN level = 'high' THEN 'expected' ELSE 'not_expected' END, sized, o FROM told
      UNION ALL
      SELECT k, level, 'extra', 'not_assessed', false, false FROM told
    ), findings AS (
      SELECT *, CASE WHEN presence = 'not_assessed' OR NOT assessed THEN 'not_assessed'
                     WHEN presence = 'expected' THEN CASE WHEN matched THEN 'found' ELSE 'missed' END
                     WHEN matched THEN 'unexpected' ELSE 'absent' END AS outcome FROM grid
    )
    """


@query(
    "jn10_findings_at_level",
    AT_LEVEL
    + """
    SELECT 'run-' || k || '-' || level AS run_id, 'part-' || k AS scenario_id, ioc || '-' || k AS ioc_id, level,
           presence, assessed, matched, outcome FROM findings
    """,
)
def findings_at_level(spark, folder):
    return _findings_at_level(spark, folder).drop("ordinal", "type")


@query(
    "ag07_recall_by_level",
    AT_LEVEL
    + """
    , counted AS (
      SELECT level, count(*) FILTER (outcome = 'found') AS tp, count(*) FILTER (outcome = 'missed') AS fn,
             count(*) FILTER (outcome = 'unexpected') AS fp, count(*) FILTER (outcome = 'absent') AS tn,
             count(*) FILTER (outcome = 'not_assessed') AS not_assessed FROM findings GROUP BY level)
    SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision FROM counted
    """,
)
def recall_by_level(spark, folder):
    return outcome_metrics(_findings_at_level(spark, folder), ["level"])
