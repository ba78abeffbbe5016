"""What the operators of this package share on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import work_path

# Bytes of text that one task of a text shuffle should get.
TASK_BYTES = 16 << 20


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the asked columns, under names that nothing else can clash with."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder all executors share; cuts the lineage."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(spark: SparkSession, total: int, each: int) -> int:
    """Tasks for ``total`` units of work, and no fewer than the session asks for."""
    return max(shuffle_tasks(spark), -(-int(total or 0) // each))


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of an input of fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < min(cores, 8):
        return df.repartition(cores)
    return df


def whole(text: Column | str) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


# --- columns that are carried along -------------------------------------------
# They travel as one struct with numbered fields, so that no name of theirs can
# clash with a working column.


def as_row(columns: list[str]) -> Column:
    return F.struct(F.lit(True).alias("is_row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")


def from_row(columns: list[str]) -> list[Column]:
    return [F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)]


def row_type(df: DataFrame) -> str:
    """The type of the ``row`` column, as it stands in a schema string."""
    return f"row {df.schema['row'].dataType.simpleString()}"
