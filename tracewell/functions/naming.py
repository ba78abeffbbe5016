"""Names, ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_ID = r"^([^_]+)_(.+)_(\d{8}-\d{6})$"
RUN_TIME = "yyyyMMdd-HHmmss"


def distro_family(distro: Column) -> Column:
    """The part of a distro id before its first ``-``."""
    return F.split_part(distro, F.lit("-"), F.lit(1))


def symbol_filename(distro: Column, kernel: Column) -> Column:
    """``<family>_<kernel>.json``; a slash in the kernel becomes ``_``."""
    return F.concat(
        distro_family(distro), F.lit("_"), F.replace(kernel, F.lit("/"), F.lit("_")), F.lit(".json")
    )


def url_filename(url: Column) -> Column:
    """Last path segment of a URL, closing slashes ignored."""
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def effective_filename(name: Column, url: Column) -> Column:
    """The given name, or the URL's own if none or an empty one is given."""
    return F.coalesce(F.nullif(name, F.lit("")), url_filename(url))


def build_run_id(distro: Column, scenario: Column, ts: Column) -> Column:
    """``<distro>_<scenario>_<yyyyMMdd-HHmmss>``."""
    return F.concat(distro, F.lit("_"), scenario, F.lit("_"), F.date_format(ts, RUN_TIME))


def parse_run_id(run_id: Column) -> Column:
    """Struct of distro, scenario and ts; null if the id is malformed.

    A distro id holds no ``_``, so the first one ends it; the scenario keeps
    any of its own. The time in an id has no zone, hence TIMESTAMP_NTZ.
    """
    ts = F.try_to_timestamp(F.regexp_extract(run_id, RUN_ID, 3), F.lit(RUN_TIME))
    parsed = F.struct(
        F.regexp_extract(run_id, RUN_ID, 1).alias("distro"),
        F.regexp_extract(run_id, RUN_ID, 2).alias("scenario"),
        ts.cast("timestamp_ntz").alias("ts"),
    )
    return F.when(run_id.rlike(RUN_ID) & ts.isNotNull(), parsed)


def technique_full(technique: Column, sub: Column) -> Column:
    """``T1070`` and ``003`` to ``T1070.003``; no sub-technique, no dot."""
    return F.concat_ws(".", technique, F.nullif(sub, F.lit("")))


def technique_parts(full: Column) -> Column:
    """Struct of technique and sub_technique; the latter null without a dot."""
    return F.struct(
        F.split_part(full, F.lit("."), F.lit(1)).alias("technique"),
        F.nullif(F.split_part(full, F.lit("."), F.lit(2)), F.lit("")).alias("sub_technique"),
    )


def rebase_path(path: Column, root: Column) -> Column:
    """Anchor a relative path at a root; an absolute path stays as it is."""
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path)
    )


def relative_path(path: Column, root: Column, mode: str = "null") -> Column:
    """Path below a root; outside it null, or an error with ``mode='error'``."""
    anchor = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    outside = (
        F.raise_error(F.concat(path, F.lit(" is not below "), root))
        if mode == "error"
        else F.lit(None)
    )
    return F.when(path.startswith(anchor), F.substr(path, F.length(anchor) + 1)).otherwise(
        outside.cast("string")
    )


def strip_marker(name: Column) -> Column:
    """A listed file name without its markers.

    First any leading run of dots and slashes goes, then any of asterisks.
    """
    return F.ltrim(F.ltrim(name, F.lit("./")), F.lit("*"))
