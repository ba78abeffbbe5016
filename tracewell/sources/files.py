"""File listings and digests of files of any size."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import work_path

# Fixed value: bytes read at a time when hashing.
CHUNK = 4 * 1024 * 1024


# Folders that a task lists before it hands the rest back, and rows of a batch.
FOLDERS_AT_ONCE = 1_000
LISTED_ROWS = 10_000

LISTED = "folder STRING, inside STRING, is_folder BOOLEAN, path STRING, size_bytes BIGINT, mtime TIMESTAMP"


def _store(uri: str) -> tuple[Any, str, str]:
    """File system of a URI or path, the path in it, and what to put before one."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    return store, inner, uri[: len(uri) - len(inner)] if uri.endswith(inner) else ""


def _list_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists the folders of a batch and those below, up to a number of folders.

    Further folders come back as rows. A file in place of a folder is itself its
    listing. At hand are the entries of one folder and the folders ahead.
    """
    from pyarrow import fs

    for batch in batches:
        ahead = deque(zip(batch["folder"], batch["inside"], batch["path"]))
        limit, listed = max(FOLDERS_AT_ONCE, len(batch)), 0
        out: list[tuple] = []
        while ahead:
            root, inside, uri = ahead.popleft()
            listed += 1
            store, inner, prefix = _store(uri)
            here = store.get_file_info(inner)
            if here.type == fs.FileType.NotFound:
                raise FileNotFoundError(uri)
            lone = here.type == fs.FileType.File
            for f in [here] if lone else store.get_file_info(fs.FileSelector(inner)):
                below = f"{inside}/{f.base_name}" if inside else f.base_name
                is_folder = f.type == fs.FileType.Directory
                if is_folder and listed + len(ahead) < limit:
                    ahead.append((root, below, prefix + f.path))
                elif is_folder or f.type == fs.FileType.File:
                    out.append((root, below, is_folder, prefix + f.path, f.size, f.mtime))
                if len(out) >= LISTED_ROWS:
                    yield _listed_rows(out)
                    out = []
        if out:
            yield _listed_rows(out)


def _listed_rows(out: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame(out, columns=[column.split()[0] for column in LISTED.split(", ")])
    return rows.assign(mtime=pd.to_datetime(rows["mtime"], utc=True), size_bytes=rows["size_bytes"].astype("Int64"))


def listing(spark: SparkSession, folders: str | Sequence[str] | DataFrame) -> DataFrame:
    """Files below folders: folder, inside (the path in it), path, size_bytes and mtime.

    A frontier of folders is dealt out over tasks; what a task does not get to is
    the next frontier, dealt out anew. Each round is a table in the shared folder,
    so neither a task nor the driver holds a tree; one of up to
    ``FOLDERS_AT_ONCE`` folders takes a single round.
    """
    if not isinstance(folders, DataFrame):
        names = [folders] if isinstance(folders, str) else list(folders)
        folders = spark.createDataFrame([(name,) for name in names], "folder STRING")
    tasks = spark.sparkContext.defaultParallelism
    frontier = folders.select("folder", F.lit("").alias("inside"), F.col("folder").alias("path"))
    rounds = []
    while not rounds or not frontier.isEmpty():
        out = work_path(spark, "listing")
        frontier.repartition(tasks).mapInPandas(_list_some, LISTED).write.parquet(out)
        rounds.append(out)
        frontier = spark.read.schema(LISTED).parquet(out).where("is_folder").select("folder", "inside", "path")
    return spark.read.schema(LISTED).parquet(*rounds).where("NOT is_folder").drop("is_folder")


def list_files(spark: SparkSession, folders: str | Sequence[str] | DataFrame) -> DataFrame:
    """Files below folders: path, size_bytes and mtime.

    Spark's own listing leaves out empty files, and an empty file is a finding
    here. ``folders`` may be a table with a column ``folder``, one for each run;
    trees are listed in parallel, large ones by many tasks (``listing``).
    """
    return listing(spark, folders).select("path", "size_bytes", "mtime")


def list_segments(spark: SparkSession, folders: str | Sequence[str] | DataFrame) -> DataFrame:
    """Evidence segments ``<prefix>.E??``: image_id, path, size_bytes and mtime.

    ``image_id`` is the whole prefix with its folder, as runs use the same names.
    """
    pattern = r"^(.+)\.E..$"
    return (
        list_files(spark, folders)
        .where(F.col("path").rlike(pattern))
        .select(F.regexp_extract("path", pattern, 1).alias("image_id"), "*")
    )


def list_symbols(spark: SparkSession, folders: str | Sequence[str] | DataFrame) -> DataFrame:
    """Symbol files ``<family>_<kernel>.json``."""
    pattern = r"^([^_]+)_(.*)\.json$"
    return (
        list_files(spark, folders)
        .select(F.substring_index("path", "/", -1).alias("file_name"))
        .where(F.col("file_name").rlike(pattern))
        .select(
            F.regexp_extract("file_name", pattern, 1).alias("family"),
            F.regexp_extract("file_name", pattern, 2).alias("kernel"),
            "file_name",
        )
    )


def file_digests(files: DataFrame, path: str = "path", algo: str = "algo") -> DataFrame:
    """Adds ``digest``, read in chunks so that no file has to fit in memory.

    A digest is sequential, so a file is the unit of work. Files are dealt out
    round-robin, without regard to their folder or name.
    """
    rest = [f for f in files.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", digest STRING"

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(uri: str, name: str) -> str:
            store, inner, _ = _store(uri)
            state = hashlib.new(name)
            with store.open_input_stream(inner) as stream:
                while block := stream.read(CHUNK):
                    state.update(block)
            return state.hexdigest()

        for batch in batches:
            yield batch.assign(
                digest=[one(p, a) for p, a in zip(batch[path], batch[algo])]
            )

    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(tasks).mapInPandas(digests, schema)
