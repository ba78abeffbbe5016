"""Image integrity, symbol files, test selection and registry checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import distro_family
from tracewell.operators.skew import BROADCAST_ROWS, ROWS_PER_TASK, checked_join, salted_join


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps only the best row per key and map task before the shuffle
    (WindowGroupLimit), so the size of a group does not matter.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def verify_checksums(
    images: DataFrame, lines: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Adds ``expected`` and ``status`` to images.

    ``images`` has image_id, list_id, file_name and digest (null if there is no
    file); ``lines`` are the checksum lists by list_id, as ``checksum_lines``
    gives them. The status is absent, not_listed, mismatch or ok.
    """
    listed = first_match(lines, ["list_id", "file_name"], ["line_no", "hash"]).select(
        "list_id", "file_name", F.col("hash").alias("expected")
    )
    joined = salted_join(
        images, listed, ["list_id", "file_name"], "left", ["image_id"], rows_per_task
    )
    status = (
        F.when(F.col("digest").isNull(), "absent")
        .when(F.col("expected").isNull(), "not_listed")
        .when(F.col("digest") != F.col("expected"), "mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def resolve_symbols(
    distros: DataFrame,
    symbols: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Distros with the symbol file of their family, the last one by name.

    Names compare as text: ``5.15.0-91`` comes after ``5.15.0-101``.
    """
    latest = symbols.groupBy("family").agg(F.max("file_name").alias("file_name"))
    named = distros.withColumn("family", distro_family(F.col("distro_id")))
    return checked_join(
        named, latest, ["family"], "inner", ["distro_id"], broadcast_rows, rows_per_task
    )


def missing_symbols(
    distros: DataFrame, symbols: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Distros whose family has no symbol file."""
    families = symbols.select("family").distinct()
    named = distros.withColumn("family", distro_family(F.col("distro_id")))
    return salted_join(named, families, ["family"], "left_anti", ["distro_id"], rows_per_task)


def select_tests(
    registry: DataFrame,
    catalog: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Tests each registry entry selects.

    An entry with a guid selects that test of its technique, one without a guid
    every test of it. Each kind has an equi-join of its own.
    """
    no_guid = F.coalesce(F.col("test_guid"), F.lit("")) == ""
    everything = registry.where(no_guid).drop("test_guid")
    single = registry.where(~no_guid).withColumnRenamed("test_guid", "guid")
    sizes = (broadcast_rows, rows_per_task)
    return checked_join(
        catalog, everything, ["technique_id"], "inner", ["guid"], *sizes
    ).unionByName(
        checked_join(catalog, single, ["technique_id", "guid"], "inner", ["guid"], *sizes)
    )


def validate_registry(
    requests: DataFrame,
    registry: DataFrame,
    profiles: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds to each request (request_id, distro_id, key) why it cannot run.

    ``reason`` is no_profile, unknown_scenario, no_technique or, if nothing is
    in the way, ok. A key that several registry files declare counts once, with the
    least technique any of them names.
    """
    known = profiles.select("distro_id").distinct().withColumn("__profile", F.lit(True))
    entries = registry.groupBy("key").agg(F.min("technique_id").alias("technique_id"), F.lit(True).alias("__entry"))
    spread, sizes = ["request_id"], (broadcast_rows, rows_per_task)
    joined = checked_join(requests, known, ["distro_id"], "left", spread, *sizes)
    joined = checked_join(joined, entries, ["key"], "left", spread, *sizes)
    reason = (
        F.when(F.col("__profile").isNull(), "no_profile")
        .when(F.col("__entry").isNull(), "unknown_scenario")
        .when(F.col("technique_id").isNull(), "no_technique")
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason).select(
        *requests.columns, "technique_id", "reason"
    )


# --- segments ------------------------------------------------------------------


def validate_images(images: DataFrame) -> DataFrame:
    """Adds ``valid`` to memory images (size_bytes): the file is there and not empty."""
    return images.withColumn("valid", F.coalesce(F.col("size_bytes") > 0, F.lit(False)))


def distinct_segments(segments: DataFrame) -> DataFrame:
    """One row per image and path, with the largest size that was reported."""
    return segments.groupBy("image_id", "path").agg(F.max("size_bytes").alias("size_bytes"))


def segment_totals(segments: DataFrame) -> DataFrame:
    """Per image: number and total size of its segments, the first, the list.

    A segment that is delivered several times counts once, with its largest size.
    Segment names end in ``.E`` and two characters, so the list of an image is
    bounded by the naming. ``size_bytes`` is that of the first segment by name and
    ``ewf_size_bytes`` the total.
    """
    totals = distinct_segments(segments).groupBy("image_id").agg(
        F.count("*").alias("n_segments"),
        F.min(F.struct("path", "size_bytes")).alias("first"),
        F.sum("size_bytes").alias("ewf_size_bytes"),
        F.sort_array(F.collect_list("path")).alias("segments"),
    )
    return totals.select(
        "image_id", "n_segments", "first.path", "first.size_bytes", "ewf_size_bytes", "segments"
    )


def validate_segments(images: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds n_segments, n_empty and valid: at least one segment, none empty.

    Memory images are single files, see ``validate_images``. With a ``path``, a segment
    that is delivered several times counts once.
    """
    if "path" in segments.columns:
        segments = distinct_segments(segments)
    totals = segments.groupBy("image_id").agg(
        F.count("*").alias("n_segments"),
        F.count_if(F.col("size_bytes") == 0).alias("n_empty"),
    )
    joined = images.join(totals, "image_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("n_segments", "n_empty")}
    )
    return joined.withColumn("valid", (F.col("n_segments") > 0) & (F.col("n_empty") == 0))


# --- duplicates ------------------------------------------------------------------


def duplicate_keys(
    df: DataFrame, key: str, member: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Rows that share their key: key, n_members and one member per row.

    Members stay rows, as a group of copies has no size limit.
    """
    keyed = df.select(key, member)
    repeated = keyed.groupBy(key).agg(F.count("*").alias("n_members")).where("n_members > 1")
    return salted_join(keyed, repeated, [key], "inner", [member], rows_per_task).select(
        key, "n_members", member
    )
