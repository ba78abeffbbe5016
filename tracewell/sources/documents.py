"""JSON documents: tool output, ground truth, scenarios and manifests.

Readers expect one document per file; ``multi_line=False`` reads files with one
document per line, as the writers of this package leave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import schemas
from tracewell.functions import is_json, render_template, strip_space
from tracewell.functions.text import LONG_STRINGS
from tracewell.sources.files import list_files, listing

# Attribute names of a file indicator that have a column of their own.
TYPED_ATTRIBUTES = ("path", "content_contains", "exists", "size_bytes")

# File names of tool output: <run id>__<plugin>.json
TOOL_FILE = r"([^/]+)__([^/]+)\.json$"


# --- tool output -------------------------------------------------------------


def _row_lists(payload: Column) -> tuple[Column, Column]:
    """The rows of a tool's JSON output, and whether they could all be read.

    Rows become variants one by one, so that limits of a parsed value hold for a row
    and not for the document.
    """
    start = F.substring(F.ltrim(F.translate(payload, "\t\r\n", "   ")), 1, 1)
    top = F.from_json(payload, "array<variant>", LONG_STRINGS)
    under = F.from_json(payload, "rows array<variant>", LONG_STRINGS)["rows"]
    given = F.from_json(payload, "rows string", LONG_STRINGS)["rows"]
    is_list, has_list = start == "[", (start == "{") & F.startswith(given, F.lit("["))
    rows = F.when(is_list, top).when(start == "{", under)
    lost = (is_list & top.isNull()) | (has_list & under.isNull())
    return rows, ~F.coalesce(lost, F.lit(False))


def plugin_rows(df: DataFrame, payload: str, mode: str = "fail") -> DataFrame:
    """One record per object row of a tool's JSON output.

    The rows are a top-level array or the array under ``rows``; any other
    document has none, and elements that are no objects are dropped, ``pos``
    counting them still. A document may be of any size. Invalid JSON, and a row
    that cannot be read (beyond 128 MiB), stops the job with ``mode='fail'``; with
    ``'quarantine'`` the document yields no rows here and ``plugin_quarantine`` keeps
    it. ``row`` is the element itself, ``attrs`` its fields as text.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    text = F.col(payload)
    rows, readable = _row_lists(text)
    valid = F.coalesce(is_json(text), F.lit(False))
    stop = lambda why: F.raise_error(F.lit(why)) if mode == "fail" else F.lit(None)
    checked = (
        F.when(~valid, stop("tool output is not valid JSON").cast("array<variant>"))
        .when(~readable, stop("a row of tool output cannot be read").cast("array<variant>"))
        .otherwise(rows)
    )
    rest = [c for c in df.columns if c != payload]
    fields = F.try_variant_get("row", "$", "map<string,variant>")
    as_text = lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return (
        df.select(*rest, F.posexplode(checked).alias("pos", "row"))
        .withColumn("__fields", fields)
        .where(F.col("__fields").isNotNull())
        .withColumn("attrs", F.transform_values("__fields", as_text))
        .drop("__fields")
    )


def plugin_quarantine(df: DataFrame, payload: str) -> DataFrame:
    """The records whose payload is not valid JSON or has a row that cannot be read."""
    _, readable = _row_lists(F.col(payload))
    return df.where(~F.coalesce(is_json(F.col(payload)), F.lit(False)) | ~readable)


def _file_name(uri: Column) -> Column:
    """A file's path as it was written, from the encoded form Spark gives."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _tool_files(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """Files ``<run id>__<plugin>.json`` below folders as run_id, plugin and payload.

    A JSON file of another name is no tool output and stops the job.
    """
    folders = [folders] if isinstance(folders, str) else folders
    name = _file_name(F.input_file_name())
    full = spark.read.text(folders, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    full = full.select(name.alias("path"), "value")
    # Spark skips empty files; here they are invalid documents.
    empty = list_files(spark, folders).where("size_bytes = 0 AND path LIKE '%.json'")
    part = lambda i: F.when(F.col("path").rlike(TOOL_FILE), F.regexp_extract("path", TOOL_FILE, i)).otherwise(
        F.raise_error(F.concat(F.lit("not a name of tool output: "), F.col("path")))
    )
    return full.union(empty.select("path", F.lit(""))).select(
        part(1).alias("run_id"), part(2).alias("plugin"), F.col("value").alias("payload")
    )


def read_plugin_rows(
    spark: SparkSession, folders: str | list[str], mode: str = "fail"
) -> DataFrame:
    """Rows of the tool-output files in folders."""
    return plugin_rows(_tool_files(spark, folders), "payload", mode)


def read_plugin_quarantine(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """Tool-output files that are not valid JSON."""
    return plugin_quarantine(_tool_files(spark, folders), "payload")


# --- indicators ----------------------------------------------------------------


def _typed(ioc: Column, name: str, value: Column) -> Column:
    """An attribute's value; one that cannot be read stops the job.

    Null would ask for nothing, and the indicator would match what it should not.
    """
    given = ioc["attributes"][name]
    message = F.concat(F.lit("indicator "), F.coalesce(ioc["id"], F.lit("?")), F.lit(f": cannot read {name} "), given)
    return F.when(given.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value)


def ioc_columns(ioc: Column) -> list[Column]:
    """Columns of one indicator, its free attributes typed."""
    attrs = ioc["attributes"]
    # Whole numbers in any form JSON has for them.
    number = attrs["size_bytes"].try_cast("decimal(38,18)")
    size = F.when(number == F.floor(number), number).try_cast("bigint")
    return [
        ioc["id"].alias("ioc_id"),
        ioc["type"].alias("type"),
        attrs["path"].alias("path"),
        attrs["content_contains"].alias("content_contains"),
        _typed(ioc, "exists", attrs["exists"].try_cast("boolean")).alias("exists"),
        _typed(ioc, "size_bytes", size).alias("size_bytes"),
        attrs["plugin"].alias("plugin"),
        F.map_filter(attrs, lambda k, _: ~k.isin(*TYPED_ATTRIBUTES, "plugin")).alias("attrs"),
        ioc["sources"].alias("sources"),
        ioc["evasion_note"].alias("evasion_note"),
    ]


# Verdicts on a document that cannot be taken.
EMPTY, BROKEN, TRAILING, SHAPE = "empty", "broken", "trailing", "shape"

# Names that Spark's readers pass over: metadata and hidden files.
HIDDEN = r"(^|/)[_.]"


def _document_texts(spark: SparkSession, paths: str | list[str], multi_line: bool) -> DataFrame:
    """Documents as they lie in files: ``__path``, ``__text`` and columns of partitions."""
    read = spark.read.text(paths, wholetext=multi_line)
    rest = [c for c in read.columns if c != "value"]
    texts = read.select(_file_name(F.col("_metadata.file_path")).alias("__path"), F.col("value").alias("__text"), *rest)
    if not multi_line:
        return texts.where(strip_space(F.col("__text")) != "")
    # Spark skips empty files; here they are documents that somebody failed to write.
    # Like Spark, look at files of the folder itself and of its partitions.
    empty = listing(spark, paths).where("size_bytes = 0").where(
        ~F.col("inside").rlike(HIDDEN) & F.col("inside").rlike("^([^/]+=[^/]*/)*[^/]*$")
    )
    return texts.unionByName(empty.select(F.col("path").alias("__path"), F.lit("").alias("__text")), allowMissingColumns=True)


def judged_documents(
    spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool = True
) -> DataFrame:
    """Every document with its ``__path``, ``__text``, ``__doc`` and ``__verdict``.

    The verdict is null for a single JSON object that fits the schema. Otherwise it
    is ``empty``; ``trailing``, where a document is followed by anything, such as
    another one; ``broken``, where no document can be read; or ``shape``, where the
    JSON is no object or a value is of another type. Blank lines are no documents,
    blank files are empty ones. Strings may be of any length.
    """
    texts = _document_texts(spark, paths, multi_line)
    text = F.col("__text")
    corrupt = "__corrupt"
    found = F.from_json(text, f"{schema}, {corrupt} STRING", {"columnNameOfCorruptRecord": corrupt, **LONG_STRINGS})
    plain = strip_space(text)

    def judged(parsed: Column) -> Column:
        fits = parsed["doc"].isNotNull() & parsed["doc"][corrupt].isNull()
        verdict = (
            F.when(plain == "", EMPTY)
            .when(~parsed["one"], F.when(_first_value(text), TRAILING).otherwise(BROKEN))
            .when(~F.startswith(plain, F.lit("{")) | ~fits, SHAPE)
        )
        return F.struct(parsed["doc"].dropFields(corrupt).alias("doc"), verdict.alias("verdict"))

    # Exploded from a list of one, as Spark would parse the text again for each column and filter.
    parsed = F.array(F.struct(found.alias("doc"), is_json(text).alias("one")))
    known = set(T.StructType.fromDDL(schema).names)
    rest = [c for c in texts.columns if c not in known and not c.startswith("__")]
    told = texts.select(*rest, "__path", "__text", F.explode(F.transform(parsed, judged)).alias("__judged"))
    return told.select(*rest, "__path", "__text", F.col("__judged.doc").alias("__doc"), F.col("__judged.verdict").alias("__verdict"))


def _first_value(text: Column) -> Column:
    """Whether a text begins with a JSON object or array that is complete."""
    whole = F.from_json(text, "__corrupt STRING, __none STRING", {"columnNameOfCorruptRecord": "__corrupt", **LONG_STRINGS})
    return F.coalesce(whole.isNotNull() & whole["__corrupt"].isNull(), F.lit(False))


def read_documents(
    spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool, mode: str
) -> DataFrame:
    """JSON documents of a schema.

    A document with a verdict (``judged_documents``) stops the job with
    ``mode='fail'``; with ``'quarantine'`` it is left to ``read_quarantine``.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    docs = judged_documents(spark, paths, schema, multi_line)
    good = F.col("__verdict").isNull()
    if mode == "fail":
        # The check is part of the document, so no filter on its columns comes before it,
        # and of a filter, so it is made even if no column is asked for.
        message = F.concat(F.lit("document cannot be taken ("), "__verdict", F.lit("): "), "__path")
        docs = docs.withColumn("__doc", F.when(good, F.col("__doc")).otherwise(F.raise_error(message)))
        good = F.col("__doc").isNotNull()
    rest = [c for c in docs.columns if not c.startswith("__")]
    return docs.where(good).select("__doc.*", *rest)


def read_quarantine(
    spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool = True
) -> DataFrame:
    """The documents that cannot be taken: path, verdict and text."""
    docs = judged_documents(spark, paths, schema, multi_line).where(F.col("__verdict").isNotNull())
    return docs.select(F.col("__path").alias("path"), F.col("__verdict").alias("verdict"), F.col("__text").alias("text"))


def read_ground_truth(
    spark: SparkSession, paths: str | list[str], multi_line: bool = True, mode: str = "fail"
) -> DataFrame:
    """Ground-truth documents of any shape; a missing ``iocs`` is empty."""
    docs = read_documents(spark, paths, schemas.GROUND_TRUTH, multi_line, mode)
    return docs.withColumn("iocs", F.coalesce("iocs", F.array().cast(f"array<{schemas.RAW_IOC}>")))


def ground_truth_iocs(docs: DataFrame) -> DataFrame:
    """One row per indicator of a ground-truth document, in its order."""
    return docs.select("scenario_id", F.posexplode("iocs").alias("ordinal", "ioc")).select(
        "scenario_id", "ordinal", *ioc_columns(F.col("ioc"))
    )


# --- scenarios -------------------------------------------------------------------


def read_scenarios(
    spark: SparkSession, paths: str | list[str], multi_line: bool = True, mode: str = "fail"
) -> tuple[DataFrame, DataFrame]:
    """Steps and expected indicators of scenario documents."""
    docs = read_documents(spark, paths, schemas.SCENARIO, multi_line, mode)
    return scenario_steps(docs), scenario_iocs(docs)


def scenario_steps(docs: DataFrame) -> DataFrame:
    """One row per step with its place in the scenario."""
    return docs.select(
        F.col("id").alias("scenario_id"),
        "defaults",
        F.posexplode("steps").alias("ordinal", "step"),
    ).select(
        "scenario_id",
        "ordinal",
        F.col("step.id").alias("step_id"),
        "step.description",
        "step.command",
        "step.phase",
        "step.mitre",
        "step.evasion_levels",
        "step.expected_iocs",
        "defaults",
    )


def scenario_iocs(docs: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row per indicator the scenario's ground truth declares.

    Placeholders in its path, marker and further attributes are filled from the
    scenario's defaults, overlaid by ``overrides``; unknown ones stay.
    """
    given = F.create_map(*[F.lit(x) for pair in (overrides or {}).items() for x in pair]).cast("map<string,string>")
    defaults = F.coalesce("defaults", F.create_map().cast("map<string,string>"))
    values = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)
    rows = docs.select(
        F.col("id").alias("scenario_id"), values.alias("__values"),
        F.posexplode("ground_truth.iocs").alias("ordinal", "ioc"),
    ).select("scenario_id", "ordinal", *ioc_columns(F.col("ioc")), "__values")
    fill = lambda text: render_template(text, F.col("__values"), "braces")
    return rows.withColumns({
        "path": fill(F.col("path")), "content_contains": fill(F.col("content_contains")),
        "attrs": F.transform_values("attrs", lambda _, v: fill(v)),
    }).drop("__values")


# --- manifests ---------------------------------------------------------------------


def read_manifests(
    spark: SparkSession, paths: str | list[str], multi_line: bool = True, mode: str = "fail"
) -> tuple[DataFrame, DataFrame]:
    """Runs, and their images with one row per run and kind."""
    docs = read_documents(spark, paths, schemas.MANIFEST, multi_line, mode)
    runs = docs.select(F.col("scenario_id").alias("run_id"), "created_at")
    kind = lambda name, image: F.struct(F.lit(name).alias("kind"), F.col(image).alias("image"))
    images = (
        docs.select(
            F.col("scenario_id").alias("run_id"),
            F.explode(
                F.array(kind("memory", "memory_image"), kind("disk", "disk_image"))
            ).alias("entry"),
        )
        .where("entry.image IS NOT NULL")
        .select("run_id", "entry.kind", "entry.image.*")
    )
    return runs, images
