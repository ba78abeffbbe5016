"""Running a stream over what is there and reading the result back."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ListState

from tracewell.session import work_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# A state group holds the machines of one hash value. Each call to state costs the same
# for one row as for thousands, so the groups must not grow in number with the machines.
GROUPS = 1_024
# Rows of a group are Arrow blocks in a list state. Types are spelled out: state is opened
# in tasks, where no DDL can be parsed.
BLOCKS = T.StructType([T.StructField("block", T.BinaryType())])
BLOCK_ROWS = 10_000


def group_of(column: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(groups)).cast("int").alias("part")


def append(state: ListState, rows: pd.DataFrame, schema: pa.Schema) -> None:
    """Add rows to a list state."""
    state.appendList(_blocks(rows, schema))


def keep(state: ListState, rows: pd.DataFrame, schema: pa.Schema) -> None:
    """Leave these rows in a list state, which must not be written empty."""
    if len(rows):
        state.put(_blocks(rows, schema))
    else:
        state.clear()


def held(state: ListState, schema: pa.Schema) -> pd.DataFrame:
    """The rows of a list state."""
    tables = [pa.ipc.open_stream(block).read_all() for (block,) in state.get()]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


def _blocks(rows: pd.DataFrame, schema: pa.Schema) -> list[tuple]:
    table, blocks = pa.Table.from_pandas(rows, schema, preserve_index=False).replace_schema_metadata(), []
    for at in range(0, table.num_rows, BLOCK_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_table(table.slice(at, BLOCK_ROWS))
        blocks.append((sink.getvalue().to_pybytes(),))
    return blocks


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream until its sources are read, and return what it wrote.

    Output and checkpoint lie in the shared folder. State is kept in RocksDB,
    on disk, as the stateful operators need.
    """
    spark = stream.sparkSession
    out = work_path(spark, name)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
