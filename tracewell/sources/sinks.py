"""Writers; every document goes out as one JSON line with its nulls kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Documents as JSON below ``path``.

    With a partition column, only the folders of the documents at hand are
    replaced: other runs stay.

    Rows are rebalanced by their partition column first: a folder gets few
    files, and a run with very many documents is still split over tasks. On
    very many runs a coarser column than the run (a day, a distro) keeps the
    number of folders small.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).json(path)


def write_findings(
    documents: DataFrame, path: str, partition_by: tuple[str, ...] = ("run_id",)
) -> None:
    """Findings documents as ``findings_document`` makes them."""
    _write(documents, path, partition_by)


def write_manifests(
    manifests: DataFrame, path: str, partition_by: tuple[str, ...] = ("run_id",)
) -> None:
    """Acquisition manifests, as ``read_manifests`` reads them.

    The run is the manifest's ``scenario_id``; it also names the folder.
    """
    if "run_id" in partition_by and "run_id" not in manifests.columns:
        manifests = manifests.withColumn("run_id", F.col("scenario_id"))
    _write(
        manifests.select("scenario_id", "created_at", "memory_image", "disk_image", *partition_by),
        path,
        partition_by,
    )


def write_ground_truth(
    documents: DataFrame,
    path: str,
    result: str = "result",
    partition_by: tuple[str, ...] = ("run_id",),
    cleanup: str | None = None,
) -> None:
    """Ground truth per run.

    A run whose result could not be read keeps its document, with an empty result;
    only a cleanup run (``cleanup`` names a boolean column) leaves none.
    """
    if cleanup:
        documents = documents.where(~F.coalesce(F.col(cleanup), F.lit(False))).drop(cleanup)
    kind = documents.schema[result].dataType.simpleString()
    empty = F.lit("{}") if kind == "string" else F.from_json(F.lit("{}"), kind)
    _write(documents.withColumn(result, F.coalesce(F.col(result), empty)), path, partition_by)
