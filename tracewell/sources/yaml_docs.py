"""YAML documents: technique catalogs, scenario registries, distro profiles.

Spark has no YAML reader. One Arrow function turns a document into JSON text;
typing and flattening are then Spark's, from the declared schema.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import schemas
from tracewell.functions import with_defaults


@F.pandas_udf(T.StringType())
def _yaml_to_json(texts: pd.Series) -> pd.Series:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    return texts.map(
        lambda text: json.dumps(yaml.load(text, Loader=loader), default=str),
        na_action="ignore",
    )


def _parsed(text: str, schema: str) -> Column:
    return F.from_json(_yaml_to_json(F.col(text)), schema, {"mode": "FAILFAST"})


def _documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files as (file_name, text); small YAML, so one document is one row."""
    return spark.read.text(paths, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"),
        F.col("value").alias("text"),
    )


def catalog_tests(df: DataFrame, text: str) -> DataFrame:
    """One row per test of a technique document, in its order."""
    rest = [c for c in df.columns if c != text]
    docs = df.select(*rest, _parsed(text, schemas.CATALOG).alias("doc"))
    tests = docs.select(
        *rest,
        F.col("doc.attack_technique").alias("technique_id"),
        F.col("doc.display_name").alias("technique_name"),
        F.posexplode("doc.atomic_tests").alias("ordinal", "test"),
    ).select(
        *rest,
        "technique_id",
        "technique_name",
        "ordinal",
        F.col("test.auto_generated_guid").alias("guid"),
        "test.name",
        "test.description",
        "test.supported_platforms",
        F.transform_values("test.input_arguments", lambda _, a: a["default"]).alias(
            "argument_defaults"
        ),
        "test.input_arguments",
        "test.dependency_executor_name",
        "test.dependencies",
        F.col("test.executor.name").alias("executor"),
        F.col("test.executor.elevation_required").alias("elevation_required"),
        F.col("test.executor.command").alias("command"),
        F.col("test.executor.cleanup_command").alias("cleanup_command"),
    )
    return with_defaults(tests, {"elevation_required": False})


def registry_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per scenario key; an empty document has none."""
    rest = [c for c in df.columns if c != text]
    entries = df.select(
        *rest, F.explode(_parsed(text, schemas.REGISTRY)).alias("key", "entry")
    ).select(*rest, "key", "entry.technique_id", "entry.test_guid", "entry.cleanup")
    return with_defaults(entries, {"cleanup": False})


def profile_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per distro profile."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, _parsed(text, schemas.PROFILE).alias("doc")).select(
        *rest, "doc.distro_id", "doc.os_variant", "doc.image.*"
    )


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return catalog_tests(_documents(spark, paths).select("text"), "text")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_rows(_documents(spark, path).select("text"), "text")


def read_profiles(spark: SparkSession, directory: str) -> DataFrame:
    """Profiles of a folder with their file names; no file is an error."""
    return profile_rows(_documents(spark, f"{directory}/*.yaml"), "text")
