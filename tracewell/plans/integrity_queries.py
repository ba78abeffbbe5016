"""Integrity, symbols, test selection and segments over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import integrity
from tracewell.plans.registry import query, table
from tracewell.sources import checksum_lines


def _text(column):
    return F.col(column).cast("string")


def _listed_images(spark, folder):
    """Documents as images; their lists are texts of two lines per document.

    Some images are missing, some not listed, some listed with another hash.
    The second line for a file never counts.
    """
    n = F.col("doc_id")
    image = F.concat(F.lit("doc"), _text("doc_id"), F.lit(".img"))
    docs = table(spark, folder, "documents")
    images = docs.select(
        n.alias("image_id"),
        F.col("source").alias("list_id"),
        image.alias("file_name"),
        F.when(n % 13 != 0, F.sha2("text", 256)).alias("digest"),
    )
    hash_ = F.upper(F.sha2(F.when(n % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256))
    name = F.when(n % 11 != 0, image).otherwise(F.lit("other.img"))
    text = F.concat(hash_, F.lit("  ./"), name, F.lit("\n\nlonely\n0000 *"), name, F.lit("\n"))
    lists = docs.select(F.col("source").alias("list_id"), text.alias("text"))
    return images, checksum_lines(lists, "text")


JN06 = """
    SELECT doc_id AS image_id, 'doc' || doc_id || '.img' AS file_name,
           CASE WHEN doc_id % 13 = 0 THEN 'absent' WHEN doc_id % 11 = 0 THEN 'not_listed'
                WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status,
           CASE WHEN doc_id % 11 <> 0 THEN
             sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) END AS expected
    FROM documents
    """


@query("jn06_verify_checksums", JN06)
def verify_checksums(spark, folder):
    return integrity.verify_checksums(*_listed_images(spark, folder)).select(
        "image_id", "file_name", "status", "expected"
    )


@query(
    "jn07_resolve_symbols",
    """
    WITH symbols AS (
      SELECT CAST(c_nationkey AS VARCHAR) AS family, c_nationkey || '_' || c_name || '.json' AS file_name
      FROM customer)
    SELECT DISTINCT o_orderpriority AS distro_id, split_part(o_orderpriority, '-', 1) AS family,
           (SELECT max(file_name) FROM symbols s WHERE s.family = split_part(o_orderpriority, '-', 1)) AS file_name
    FROM orders
    """,
)
def resolve_symbols(spark, folder):
    distros = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("distro_id"))
    symbols = table(spark, folder, "customer").select(
        _text("c_nationkey").alias("family"),
        F.concat(_text("c_nationkey"), F.lit("_"), F.col("c_name"), F.lit(".json")).alias("file_name"),
    )
    return integrity.resolve_symbols(distros.distinct(), symbols)


@query(
    "jn08_missing_symbols",
    """
    SELECT o_orderkey || '-' || o_orderstatus AS distro_id, CAST(o_orderkey AS VARCHAR) AS family
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    """,
)
def missing_symbols(spark, folder):
    distros = table(spark, folder, "orders").select(
        F.concat_ws("-", _text("o_orderkey"), "o_orderstatus").alias("distro_id")
    )
    symbols = table(spark, folder, "lineitem").select(_text("l_orderkey").alias("family"))
    return integrity.missing_symbols(distros, symbols)


JN09 = """
    WITH registry AS (
      SELECT DISTINCT 'all-' || p_type AS key, p_type AS technique_id, '' AS test_guid FROM part
      UNION ALL
      SELECT 'one-' || p_type || '-' || p_brand, p_type, CAST(max(p_partkey) AS VARCHAR) FROM part
      GROUP BY p_type, p_brand
    )
    SELECT key, technique_id, CAST(p_partkey AS VARCHAR) AS guid, p_name AS name
    FROM registry JOIN part ON technique_id = p_type AND (test_guid = '' OR test_guid = CAST(p_partkey AS VARCHAR))
    """


def _registry_and_catalog(spark, folder):
    part = table(spark, folder, "part")
    everything = part.select(
        F.concat(F.lit("all-"), F.col("p_type")).alias("key"),
        F.col("p_type").alias("technique_id"),
        F.lit("").alias("test_guid"),
    ).distinct()
    single = (
        part.groupBy("p_type", "p_brand")
        .agg(F.max("p_partkey").alias("last"))
        .select(
            F.concat_ws("-", F.lit("one"), "p_type", "p_brand").alias("key"),
            F.col("p_type").alias("technique_id"),
            _text("last").alias("test_guid"),
        )
    )
    catalog = part.select(
        F.col("p_type").alias("technique_id"),
        _text("p_partkey").alias("guid"),
        F.col("p_name").alias("name"),
    )
    return everything.union(single), catalog


@query("jn09_select_tests", JN09)
def select_tests(spark, folder):
    return integrity.select_tests(*_registry_and_catalog(spark, folder))


@query("jn09_select_tests_shuffled", JN09)
def select_tests_shuffled(spark, folder):
    """The way taken when the registry is too long to broadcast."""
    return integrity.select_tests(
        *_registry_and_catalog(spark, folder), broadcast_rows=0, rows_per_task=100
    )


@query(
    "jn14_validate_registry",
    """
    SELECT o_orderkey AS request_id, o_orderpriority AS distro_id, CAST(o_custkey AS VARCHAR) AS key,
           CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS technique_id,
           CASE WHEN o_orderpriority NOT IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING
                  o_orderpriority > '1-V') THEN 'no_profile'
                WHEN c_custkey IS NULL THEN 'unknown_scenario'
                WHEN c_acctbal < 0 THEN 'no_technique' ELSE 'ok' END AS reason
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o_custkey = c_custkey
    """,
)
def validate_registry(spark, folder):
    orders = table(spark, folder, "orders")
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderpriority").alias("distro_id"),
        _text("o_custkey").alias("key"),
    )
    registry = (
        table(spark, folder, "customer")
        .where("c_mktsegment <> 'BUILDING'")
        .select(
            _text("c_custkey").alias("key"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("technique_id"),
        )
    )
    profiles = requests.select("distro_id").where("distro_id > '1-V'")
    return integrity.validate_registry(requests, registry, profiles)


def _segments(spark, folder):
    """Line items as the segments of their order's image."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.format_string("%d.E%02d", "l_orderkey", "l_linenumber").alias("path"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
    )


@query(
    "ag01_segment_totals",
    """
    WITH s AS (SELECT l_orderkey AS image_id, l_orderkey || '.E0' || l_linenumber AS path,
                      max(CAST(l_quantity AS BIGINT)) AS size_bytes FROM lineitem GROUP BY ALL)
    SELECT image_id, count(*) AS n_segments, min(path) AS path, arg_min(size_bytes, path) AS size_bytes,
           CAST(sum(size_bytes) AS BIGINT) AS ewf_size_bytes,
           string_agg(DISTINCT path, ',' ORDER BY path) AS segments
    FROM s GROUP BY image_id
    """,
)
def segment_totals(spark, folder):
    totals = integrity.segment_totals(_segments(spark, folder))
    return totals.withColumn("segments", F.array_join("segments", ","))


@query(
    "ag01_segments_again",
    """
    WITH s AS (SELECT l_orderkey % 1000 AS image_id, 'd.E0' || l_linenumber AS path,
                      max(CAST(l_quantity AS BIGINT)) AS size_bytes FROM lineitem GROUP BY ALL)
    SELECT image_id, count(*) AS n_segments, min(path) AS path, arg_min(size_bytes, path) AS size_bytes,
           CAST(sum(size_bytes) AS BIGINT) AS ewf_size_bytes, string_agg(path, ',' ORDER BY path) AS segments
    FROM s GROUP BY image_id
    """,
)
def segments_again(spark, folder):
    """Segments that are delivered many times."""
    segments = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 1000).alias("image_id"),
        F.concat(F.lit("d.E0"), F.col("l_linenumber").cast("string")).alias("path"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
    )
    return integrity.segment_totals(segments).withColumn("segments", F.array_join("segments", ","))


@query(
    "ag02_validate_segments",
    """
    SELECT o_orderkey AS image_id, count(l_orderkey) AS n_segments,
           count(*) FILTER (WHERE l_discount = 0) AS n_empty,
           count(l_orderkey) > 0 AND count(*) FILTER (WHERE l_discount = 0) = 0 AS valid
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
    """,
)
def validate_segments(spark, folder):
    images = table(spark, folder, "orders").select(F.col("o_orderkey").alias("image_id"))
    segments = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("size_bytes"),
    )
    return integrity.validate_segments(images, segments)


@query(
    "ag11_duplicate_keys",
    """
    SELECT sha256(text) AS digest, n AS n_members, doc_id
    FROM documents JOIN (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
    USING (text)
    """,
)
def duplicate_keys(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return integrity.duplicate_keys(docs, "digest", "doc_id")


@query(
    "wn01_first_match",
    """
    SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1
    """,
)
def first_match(spark, folder):
    lines = table(spark, folder, "conversations").where("role = 'assistant'")
    return integrity.first_match(lines, ["conv_id"], ["turn", "text"]).select(
        "conv_id", "turn", "text"
    )
