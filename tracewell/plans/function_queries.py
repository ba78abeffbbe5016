"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import functions as fn
from tracewell.plans.registry import query, table

PROPS = "map<string,string>"


def _size_sql(size: str) -> str:
    """The size ladder in SQL, over floating-point numbers."""
    steps = "".join(
        f" WHEN {size} < {1024 ** (i + 1)} THEN printf('%.1f {unit}', {size} / {float(1024**i)})"
        for i, unit in enumerate(["KiB", "MiB", "GiB", "TiB"], start=1)
    )
    return (
        f"CASE WHEN {size} IS NULL THEN 'unknown' WHEN {size} < 1024 THEN {size} || ' B'{steps} "
        f"ELSE printf('%.1f PiB', {size} / {float(1024**5)}) END"
    )


@query(
    "fn01_format_bytes",
    f"""
    SELECT doc_id, {_size_sql('n_chars')} AS plain, {_size_sql('(n_chars * 100663)')} AS large,
           {_size_sql('(n_chars * 1099511627776)')} AS huge,
           {_size_sql("(CASE WHEN lang = 'en' THEN n_chars END)")} AS partial
    FROM documents
    """,
)
def format_bytes(spark, folder):
    n = F.col("n_chars")
    return table(spark, folder, "documents").select(
        "doc_id",
        fn.format_bytes(n).alias("plain"),
        fn.format_bytes(n * 100663).alias("large"),
        fn.format_bytes(n * 1099511627776).alias("huge"),
        fn.format_bytes(F.when(F.col("lang") == "en", n)).alias("partial"),
    )


@query(
    "fn02_distro_family",
    "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS family FROM orders",
)
def distro_family(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", fn.distro_family(F.col("o_orderpriority")).alias("family")
    )


@query(
    "fn03_symbol_filename",
    """
    SELECT o_orderkey, split_part(o_orderpriority, '-', 1) || '_' ||
           strftime(o_orderdate, '%Y_%m_%d') || '.json' AS file_name FROM orders
    """,
)
def symbol_filename(spark, folder):
    kernel = F.date_format("o_orderdate", "yyyy/MM/dd")
    return table(spark, folder, "orders").select(
        "o_orderkey", fn.symbol_filename(F.col("o_orderpriority"), kernel).alias("file_name")
    )


@query(
    "fn04_url_filename",
    "SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS file_name FROM pages",
)
def url_filename(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", fn.url_filename(F.col("url")).alias("file_name")
    )


@query(
    "fn05_effective_filename",
    """
    SELECT page_id, CASE WHEN url LIKE '%utm_source=%' THEN regexp_extract(url, 'utm_source=([a-z]+)', 1)
                         ELSE list_last(string_split(rtrim(url, '/'), '/')) END AS file_name
    FROM pages
    """,
)
def effective_filename(spark, folder):
    named = F.regexp_extract("url", "utm_source=([a-z]+)", 1)
    return table(spark, folder, "pages").select(
        "page_id", fn.effective_filename(named, F.col("url")).alias("file_name")
    )


def _run_ids(spark, folder):
    run_id = fn.build_run_id(
        F.concat(F.lit("host-"), F.col("user_id").cast("string")),
        F.concat(F.col("event_type"), F.lit("_test")),
        F.col("ts"),
    )
    return table(spark, folder, "events").select("event_id", run_id.alias("run_id"))


@query(
    "fn06_build_run_id",
    """
    SELECT event_id, 'host-' || user_id || '_' || event_type || '_test_' ||
           strftime(ts, '%Y%m%d-%H%M%S') AS run_id FROM events
    """,
)
def build_run_id(spark, folder):
    return _run_ids(spark, folder)


@query(
    "fn07_parse_run_id",
    """
    SELECT event_id, 'host-' || user_id AS distro, event_type || '_test' AS scenario,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, true AS malformed_is_null FROM events
    """,
)
def parse_run_id(spark, folder):
    parsed = _run_ids(spark, folder).withColumn("p", fn.parse_run_id(F.col("run_id")))
    malformed = fn.parse_run_id(F.replace("run_id", F.lit("-"), F.lit("")))
    return parsed.select(
        "event_id",
        "p.distro",
        "p.scenario",
        F.date_format("p.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        malformed.isNull().alias("malformed_is_null"),
    )


def _part_args():
    return F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")
    )


@query(
    "fn08_render_template",
    """
    SELECT p_partkey, p_brand || ' ' || p_size || ' #{other} # ' || p_name AS hash_style,
           '<' || p_brand || '>{{other}} ' || p_size || ' {' AS brace_style FROM part
    """,
)
def render_template(spark, folder):
    hashed = F.concat(F.lit("#{brand} #{size} #{other} # "), F.col("p_name"))
    braced = F.lit("<{{brand}}>{{other}} {{size}} {")
    return table(spark, folder, "part").select(
        "p_partkey",
        fn.render_template(hashed, _part_args(), "hash").alias("hash_style"),
        fn.render_template(braced, _part_args(), "braces").alias("brace_style"),
    )


@query(
    "fn09_digest",
    """
    SELECT doc_id, sha256(text) AS digest, lang = 'en' AS is_sha512
    FROM documents WHERE lang <> 'en'
    UNION ALL SELECT doc_id, NULL, true FROM documents WHERE lang = 'en'
    """,
)
def digest(spark, folder):
    english = F.col("lang") == "en"
    algo = F.when(english, "SHA512").otherwise("SHA256")
    value = fn.digest(F.col("text"), algo)
    # The SQL engine has no SHA-512: only its length is checked here.
    return table(spark, folder, "documents").select(
        "doc_id",
        F.when(~english, value).alias("digest"),
        (F.length(value) == 128).alias("is_sha512"),
    )


@query(
    "fn10_technique",
    """
    SELECT p_partkey, p_type || '.' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS full_id,
           p_type AS technique, lpad(CAST(p_size AS VARCHAR), 3, '0') AS sub_technique,
           p_type AS bare FROM part
    """,
)
def technique(spark, folder):
    sub = F.lpad(F.col("p_size").cast("string"), 3, "0")
    return (
        table(spark, folder, "part")
        .withColumn("full_id", fn.technique_full(F.col("p_type"), sub))
        .withColumn("parts", fn.technique_parts(F.col("full_id")))
        .select(
            "p_partkey", "full_id", "parts.*",
            fn.technique_full(F.col("p_type"), F.lit("")).alias("bare"),
        )
    )


@query(
    "fn11_paths",
    """
    SELECT page_id, substr(url, length(regexp_extract(url, '^https?://[^/]+')) + 2) AS relative,
           '/base/' || substr(url, length(regexp_extract(url, '^https?://[^/]+')) + 2) AS rebased,
           CASE WHEN starts_with(url, 'https://spam-farm.example.org/') THEN substr(url, 31) END AS farm FROM pages
    """,
)
def paths(spark, folder):
    url = F.col("url")
    relative = fn.relative_path(url, F.regexp_extract(url, "^https?://[^/]+", 0), "error")
    return table(spark, folder, "pages").select(
        "page_id",
        relative.alias("relative"),
        fn.rebase_path(relative, F.lit("/base/")).alias("rebased"),
        fn.relative_path(url, F.lit("https://spam-farm.example.org")).alias("farm"),
    )


@query(
    "fn12_strip_marker",
    """
    SELECT event_id, CASE WHEN event_type = 'click' THEN './img' || event_id
                          ELSE 'img' || event_id END AS file_name FROM events
    """,
)
def strip_marker(spark, folder):
    # Fixed order: dots and slashes go first, so "*./" keeps its second part.
    marker = F.element_at(
        F.create_map(
            *map(F.lit, ["click", "*./", "view", "./", "error", "*", "signup", ".././**"])
        ),
        F.col("event_type"),
    )
    listed = F.concat(
        F.coalesce(marker, F.lit("")), F.lit("img"), F.col("event_id").cast("string")
    )
    return table(spark, folder, "events").select(
        "event_id", fn.strip_marker(listed).alias("file_name")
    )


@query(
    "fn13_has_value",
    """
    SELECT event_id, event_type NOT IN ('error', 'view') AS has_pid, true AS has_k FROM events
    """,
)
def has_value(spark, folder):
    pid = (
        F.when(F.col("event_type") == "error", '""')
        .when(F.col("event_type") == "view", "null")
        .otherwise(F.col("user_id").cast("string"))
    )
    row = F.parse_json(F.concat(F.lit('{"PID":'), pid, F.lit(","), F.expr("substr(props, 2)")))
    return table(spark, folder, "events").select(
        "event_id",
        fn.has_value(row, "PID").alias("has_pid"),
        fn.has_value(row, "k").alias("has_k"),
    )


@query(
    "fn14_with_defaults",
    """
    SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)
def with_defaults(spark, folder):
    joined = (
        table(spark, folder, "documents")
        .select("doc_id")
        .join(table(spark, folder, "labels"), "doc_id", "left")
    )
    return fn.with_defaults(joined, {"quality": 0, "toxic": 0})


@query(
    "fn15_resolve_args",
    """
    SELECT p_partkey, p_brand || '/' || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '10' END
           || '/' || p_name AS tag FROM part
    """,
)
def resolve_args(spark, folder):
    defaults = F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("10")
    )
    overrides = F.create_map(
        F.lit("size"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")),
        F.lit("name"),
        F.col("p_name"),
    )
    args = fn.resolve_args(defaults, overrides)
    return table(spark, folder, "part").select(
        "p_partkey",
        fn.render_template(F.lit("#{brand}/#{size}/#{name}"), args, "hash").alias("tag"),
    )


@query(
    "fn16_supports",
    """
    SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has_the FROM documents
    """,
)
def supports(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", fn.supports(F.split("text", " "), "the").alias("has_the")
    )


@query(
    "fn17_matches_attrs",
    """
    SELECT event_id, json_extract_string(props, '$.k') = '9' AS is_nine,
           json_extract_string(props, '$.k') = CAST(user_id AS VARCHAR) AS is_user,
           true AS lacks_pid FROM events
    """,
)
def matches_attrs(spark, folder):
    row = F.from_json("props", PROPS)
    k = lambda value: F.create_map(F.lit("k"), value)
    return table(spark, folder, "events").select(
        "event_id",
        fn.matches_attrs(k(F.lit("9")), row).alias("is_nine"),
        fn.matches_attrs(k(F.col("user_id").cast("string")), row).alias("is_user"),
        fn.matches_attrs(
            F.create_map(F.lit("PID"), F.lit(None).cast("string")), row
        ).alias("lacks_pid"),
    )
