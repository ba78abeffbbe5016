"""Matching indicators of compromise against collected evidence.

Indicators are tables as ``schemas.EXPECTED_IOC`` describes them; with a
``run_id`` they say what a run was to show, without it they are definitions for
every run. Many of them ask for the same thing: the same path in a thousand
scenarios. So evidence meets each distinct condition once, which gives distinct
(run, condition) pairs, and only those meet the indicators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracewell.functions import matches_attrs
from tracewell.operators.markers import found_by_index, found_by_join, portions
from tracewell.operators.skew import (
    BROADCAST_ROWS,
    ROWS_PER_TASK,
    checked_join,
    fits,
    measure,
    salted_join,
)
from tracewell.session import work_path

IOC_KEY = ("scenario_id", "ioc_id")

# Markers a text is searched for one by one. More are found by their grams.
SCAN_MARKERS = 64

# Stands for every source; no tool has an empty name.
ANY_SOURCE = ""

NO_ATTRS = "CAST(map() AS MAP<STRING, STRING>)"


@dataclass
class Evidence:
    """What was collected: file entries and tool rows, either may be missing."""

    entries: DataFrame | None = None
    rows: DataFrame | None = None


@dataclass(frozen=True)
class Limits:
    """Where the way to join changes; tests set them low to take every way."""

    scan_markers: int = SCAN_MARKERS
    broadcast_rows: int = BROADCAST_ROWS
    rows_per_task: int = ROWS_PER_TASK


def _with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


# --- conditions ------------------------------------------------------------------


def _condition(columns: Sequence[str]) -> Column:
    """One text for what an indicator asks for; nulls count."""
    asked = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(asked, 256)


def _conditions(iocs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct condition with its key."""
    keyed = iocs.select(_condition(columns).alias("__cond"), *columns)
    return keyed.dropDuplicates(["__cond"])


def _pairs(
    iocs: DataFrame, hits: DataFrame, columns: Sequence[str], limits: Limits
) -> DataFrame:
    """(run, indicator) pairs from distinct (run, condition) hits."""
    keyed = iocs.withColumn("__cond", _condition(columns))
    if "run_id" in iocs.columns:
        met = keyed.join(hits, ["run_id", "__cond"], "left_semi")
    else:
        met = checked_join(
            hits,
            keyed.select("__cond", *IOC_KEY),
            ["__cond"],
            "inner",
            ["run_id"],
            limits.broadcast_rows,
            limits.rows_per_task,
        )
    return met.select("run_id", *IOC_KEY).distinct()


def _no_pairs(evidence: DataFrame) -> DataFrame:
    """No (run, indicator) pairs; nothing is read for them."""
    no_ids = [F.lit(None).cast("string").alias(c) for c in IOC_KEY]
    return evidence.select("run_id", *no_ids).where("false")


# --- files -------------------------------------------------------------------------


def match_file_iocs(
    entries: DataFrame,
    iocs: DataFrame,
    definitions: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Runs with an entry at an indicator's path that meets its size and content.

    ``content`` is read only if an indicator asks for it. ``definitions`` saves
    taking the conditions from a long table of what every run was to show.
    """
    columns = ["path", "size_bytes", "content_contains"]
    iocs = iocs.where("path IS NOT NULL")
    wanted = _conditions(
        iocs if definitions is None else definitions.where("path IS NOT NULL"), columns
    ).select(
        "__cond",
        "path",
        F.col("size_bytes").alias("__size"),
        F.col("content_contains").alias("__marker"),
    )
    entries = _with_columns(entries, {"content": "string", "size_bytes": "bigint"})
    used = entries.select("run_id", "path", "size_bytes", "content")
    size = measure(wanted, markers=F.count("__marker"))
    if not size["rows"]:
        return _no_pairs(entries)
    if not size["markers"]:
        used = used.withColumn("content", F.lit(None).cast("string"))
    if fits(size["rows"], size["chars"], limits.broadcast_rows):
        joined = used.join(F.broadcast(wanted), "path")
    else:
        spread = ["run_id", "size_bytes"]
        joined = salted_join(used, wanted, ["path"], "inner", spread, limits.rows_per_task)
    hits = (
        joined.where("__size IS NULL OR size_bytes = __size")
        .where("__marker IS NULL OR contains(content, __marker)")
        .select("run_id", "__cond")
        .distinct()
    )
    return _pairs(iocs, hits, columns, limits)


# --- content -------------------------------------------------------------------------


def content_hits(
    entries: DataFrame,
    markers: DataFrame,
    content: str = "content",
    marker: str = "content_contains",
    keep: Sequence[str] = ("run_id",),
    limits: Limits = Limits(),
) -> DataFrame:
    """Distinct pairs of an entry and a marker its content contains.

    Keeps the entry's ``keep`` columns and the marker's other columns; only in a
    stream, which cannot tell yet, a pair may come more than once.

    Few markers are broadcast and searched for in each text one by one. More are
    looked up by their rarest gram (see ``markers``), which a text is searched for
    all at once: from a broadcast index, or, if it would be too large, by a join.
    """
    keep = list(keep)
    other = [c for c in markers.columns if c != marker]
    markers = markers.where(F.col(marker).isNotNull())
    texts = entries.select(*keep, F.col(content).alias("__text")).where("__text IS NOT NULL")
    unique = markers.select(F.col(marker).alias("__marker")).distinct()
    size = measure(unique, empty=F.count_if(F.col("__marker") == ""))
    small = fits(size["rows"], size["chars"], limits.broadcast_rows)
    if small and size["rows"] <= limits.scan_markers:
        found = F.contains(F.col("__text"), F.col("__marker"))
        hits = texts.join(F.broadcast(unique), found, "inner").select(*keep, "__marker")
    else:
        grammed = unique.where("__marker <> ''")
        if small or texts.isStreaming:
            lists = portions(r["__marker"] for r in grammed.toLocalIterator())
            parts = [found_by_index(texts, keep, part) for part in lists]
        else:
            parts = [found_by_join(texts, keep, grammed, limits.rows_per_task)]
        if size["empty"]:  # every text contains it
            parts.append(texts.select(*keep, F.lit("").alias("__marker")))
        hits = reduce(DataFrame.union, parts)
    hits = hits if texts.isStreaming else hits.distinct()
    named = markers.select(F.col(marker).alias("__marker"), *other)
    if entries.isStreaming:
        joined = hits.join(named, "__marker")
    else:
        sizes = (limits.broadcast_rows, limits.rows_per_task)
        joined = checked_join(hits, named, ["__marker"], "inner", keep, *sizes)
    return joined.select(*keep, *other)


def match_content_iocs(
    entries: DataFrame,
    iocs: DataFrame,
    definitions: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Runs with an entry, at whatever path, whose content holds the marker."""
    anywhere = "path IS NULL AND content_contains IS NOT NULL"
    columns = ["size_bytes", "content_contains"]
    iocs = iocs.where(anywhere)
    wanted = _conditions(
        iocs if definitions is None else definitions.where(anywhere), columns
    ).select("__cond", "content_contains", F.col("size_bytes").alias("__size"))
    entries = _with_columns(entries, {"size_bytes": "bigint"})
    hits = (
        content_hits(entries, wanted, keep=["run_id", "size_bytes"], limits=limits)
        .where("__size IS NULL OR size_bytes = __size")
        .select("run_id", "__cond")
        .distinct()
    )
    return _pairs(iocs, hits, columns, limits)


# --- absence ---------------------------------------------------------------------------


def match_absent_iocs(
    entries: DataFrame,
    expected: DataFrame,
    definitions: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Absence indicators of each run: ``matched`` and ``assessed``.

    One matches if the run has no entry at its path. That says something only
    if the run was looked at: with no entry from any of the indicator's sources
    (from any source, if it names none) it is neither assessed nor matched.
    """
    key = ["run_id", *IOC_KEY]
    named = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit(ANY_SOURCE)))
    of_absence = "path IS NOT NULL AND `exists` = false"
    absent = expected.where(of_absence).select(*key, "path", F.explode(named).alias("source"))
    asked = expected if definitions is None else definitions
    # Of all entries only those at an asked path move.
    present = (
        checked_join(
            entries.select("run_id", "path"),
            asked.where(of_absence).select("path").distinct(),
            ["path"],
            "left_semi",
            ["run_id"],
            limits.broadcast_rows,
            limits.rows_per_task,
        )
        .distinct()
        .withColumn("__found", F.lit(True))
    )
    sources = F.explode(F.array(F.col("source"), F.lit(ANY_SOURCE))).alias("source")
    looked = entries.select("run_id", sources).distinct().withColumn("__looked", F.lit(True))
    return (
        absent.join(present, ["run_id", "path"], "left")
        .join(looked, ["run_id", "source"], "left")
        .groupBy(*key)
        .agg(
            F.coalesce(F.bool_or("__looked"), F.lit(False)).alias("assessed"),
            F.coalesce(F.bool_or("__found"), F.lit(False)).alias("__found"),
        )
        .select(*key, "assessed", (F.col("assessed") & ~F.col("__found")).alias("matched"))
    )


# --- processes ---------------------------------------------------------------------------


def match_process_iocs(
    rows: DataFrame,
    iocs: DataFrame,
    definitions: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Runs with a tool row that has every attribute of an indicator.

    A row meets only the conditions that share one attribute value with it, the
    first in name order, and is then checked for the others. A condition
    without any value is met by a row that lacks the named fields; the few
    distinct sets of fields of a run and plugin decide that.
    """
    columns = ["plugin", "attrs"]
    of_plugin = lambda df: df.where("plugin IS NOT NULL").withColumn(
        "attrs", F.coalesce("attrs", F.expr(NO_ATTRS))
    )
    iocs = of_plugin(iocs)
    wanted = _conditions(iocs if definitions is None else of_plugin(definitions), columns)
    hits = process_hits(rows, wanted, limits)
    return _no_pairs(rows) if hits is None else _pairs(iocs, hits.distinct(), columns, limits)


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str, small: bool, spread: list[str], limits: Limits) -> DataFrame:
    """Evidence with conditions: broadcast if small, else salted; a stream cannot be counted first."""
    if small:
        return left.join(F.broadcast(right), on, how)
    if left.isStreaming:
        return left.join(right, on, how)
    return salted_join(left, right, on, how, spread, limits.rows_per_task)


def process_hits(
    rows: DataFrame, wanted: DataFrame, limits: Limits = Limits(), keep: Sequence[str] = ()
) -> DataFrame | None:
    """(run, condition) of rows that meet a condition: ``__cond``, ``plugin``, ``attrs``.

    None if there are no conditions. ``keep`` names further columns of the rows.
    """
    given = F.array_sort(F.map_keys(F.map_filter("__wanted", lambda _, v: v.isNotNull())))
    wanted = wanted.withColumnRenamed("attrs", "__wanted").withColumn("__name", F.get(given, F.lit(0)))
    by_value = wanted.where("__name IS NOT NULL").withColumn(
        "__value", F.element_at("__wanted", F.col("__name"))
    )
    by_shape = wanted.where("__name IS NULL").drop("__name")
    size = measure(wanted, bare=F.count_if(F.col("__name").isNull()))
    if not size["rows"]:
        return None
    small = fits(size["rows"], size["chars"], limits.broadcast_rows)

    # The outer form, as Spark would evaluate the map again to drop empty ones.
    fields = rows.select(
        "run_id", *keep, "plugin", "attrs", F.explode_outer("attrs").alias("__name", "__value")
    ).where("__value IS NOT NULL")
    valued = _meet(fields, by_value, ["plugin", "__name", "__value"], "inner", small, ["run_id"], limits)
    hits = valued.where(matches_attrs(F.col("__wanted"), F.col("attrs"))).select(
        "run_id", *keep, "__cond"
    )
    if size["bare"]:
        shape = F.array_sort(F.map_keys(F.map_filter("attrs", lambda _, v: v.isNotNull())))
        shapes = rows.select("run_id", *keep, "plugin", shape.alias("__shape"))
        shapes = shapes if rows.isStreaming else shapes.distinct()
        lacking = F.forall(
            F.map_keys("__wanted"), lambda k: ~F.array_contains(F.col("__shape"), k)
        )
        met = _meet(shapes, by_shape, ["plugin"], "inner", small, ["run_id"], limits)
        hits = hits.union(met.where(lacking).select("run_id", *keep, "__cond"))
    return hits


# --- all indicators from one pass -------------------------------------------------------
#
# Every condition gets a number, whatever it is about: an entry at a path (with a
# size, a marker), a marker anywhere, a tool row, that a run was looked at from a
# source or by a plugin. Evidence meets the conditions once and gives, for each run,
# the bits of those that hold, in words of 64. Findings only look at bits: an absence
# needs one that is not set and one of its sources that is.

AT_PATH, IN_TEXT, IN_ROW, LOOKED, PLUGIN = "path", "text", "row", "source", "plugin"

CONDITION = {
    "path": "string", "size_bytes": "bigint", "content_contains": "string",
    "plugin": "string", "attrs": "map<string,string>", "source": "string",
}


def _tag(kind: str, **given: Column) -> Column:
    """One condition as a struct of one shape; what it does not ask for is null."""
    fields = [given.get(c, F.lit(None)).cast(k).alias(c) for c, k in CONDITION.items()]
    return F.struct(F.lit(kind).alias("kind"), *fields)


def _main_condition() -> Column:
    """What must hold (or, for an absence, not hold) for an indicator; null if nothing can."""
    path, size, marker = F.col("path"), F.col("size_bytes"), F.col("content_contains")
    absent = F.coalesce(F.col("exists") == F.lit(False), F.lit(False))
    of_file = (
        F.when(absent & path.isNotNull(), _tag(AT_PATH, path=path))
        .when(~absent & path.isNotNull(), _tag(AT_PATH, path=path, size_bytes=size, content_contains=marker))
        .when(~absent & marker.isNotNull(), _tag(IN_TEXT, size_bytes=size, content_contains=marker))
    )
    of_row = F.when(
        F.col("plugin").isNotNull(),
        _tag(IN_ROW, plugin=F.col("plugin"), attrs=F.coalesce("attrs", F.expr(NO_ATTRS))),
    )
    return F.when(F.col("type") == "file", of_file).when(F.col("type") == "process", of_row)


def _looks() -> Column:
    """Which looks at a run an indicator can be told from, any of them."""
    sources = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit(ANY_SOURCE)))
    by_plugin = F.array(_tag(PLUGIN, plugin=F.col("plugin")))
    by_source = F.transform(sources, lambda s: _tag(LOOKED, source=s))
    return F.when(F.col("type") == "file", by_source).when(
        (F.col("type") == "process") & F.col("plugin").isNotNull(), by_plugin
    )


def _key(condition: Column) -> Column:
    return F.when(condition.isNotNull(), F.sha2(F.to_json(condition, {"ignoreNullFields": "false"}), 256))


def numbered_conditions(definitions: DataFrame, every_look: bool = False) -> DataFrame:
    """The distinct conditions with numbers, as a table in the shared folder.

    A number is given once: plans that read the table again find the same.
    """
    looks = _looks() if every_look else F.when(F.col("exists") == F.lit(False), _looks())
    asked = definitions.select(
        F.explode(F.array_compact(F.concat(F.array(_main_condition()), F.coalesce(looks, F.array())))).alias("c")
    )
    path = work_path(definitions.sparkSession, "conditions")
    asked.select(_key(F.col("c")).alias("__key"), "c").dropDuplicates(["__key"]).select(
        "__key", F.monotonically_increasing_id().alias("__cond"), "c.*"
    ).write.parquet(path)
    return definitions.sparkSession.read.parquet(path)


def _chars(which: Column, name: str) -> Column:
    """Characters of a column in some rows; each row counts for a few more."""
    return F.coalesce(F.sum(F.when(which, F.length(name) + 16)), F.lit(0))


def _entry_hits(entries: DataFrame, conditions: DataFrame, sizes: Row, limits: Limits, keep: list[str]) -> DataFrame:
    """(run, condition) of paths and sources, from a single reading of the entries."""
    entries = _with_columns(entries, {"content": "string", "size_bytes": "bigint", "source": "string"})
    used = entries.select("run_id", *keep, "path", "size_bytes", "content", "source")
    if not sizes["markers"]:
        used = used.withColumn("content", F.lit(None).cast("string"))
    by_path = conditions.where(F.col("kind") == AT_PATH).select(
        "path", F.col("size_bytes").alias("__size"), F.col("content_contains").alias("__marker"),
        F.col("__cond").alias("__at"),
    )
    how = "left" if sizes["looks"] else "inner"
    small = fits(sizes["paths"], sizes["chars"], limits.broadcast_rows)
    met = _meet(used, by_path, ["path"], how, small, ["run_id", "size_bytes"], limits)
    holds = (
        F.col("__at").isNotNull()
        & (F.col("__size").isNull() | F.coalesce(F.col("size_bytes") == F.col("__size"), F.lit(False)))
        & (F.col("__marker").isNull() | F.coalesce(F.contains("content", "__marker"), F.lit(False)))
    )
    found = [F.when(holds, F.col("__at"))]
    if sizes["looks"]:
        looks = conditions.where(F.col("kind") == LOOKED).select("source", F.col("__cond").alias("__look"))
        named = looks.where(F.col("source") != ANY_SOURCE)
        small = fits(sizes["looks"], sizes["look_chars"], limits.broadcast_rows)
        met = _meet(met, named, ["source"], "left", small, ["run_id"], limits)
        found.append(F.col("__look"))
        anything = looks.where(F.col("source") == ANY_SOURCE).first()
        if anything is not None:
            found.append(F.lit(anything["__look"]))
    return met.select("run_id", *keep, F.explode(F.array_compact(F.array(*found))).alias("__cond"))


def condition_hits(
    evidence: Evidence, conditions: DataFrame, limits: Limits = Limits(), keep: Sequence[str] = ()
) -> list[DataFrame]:
    """(run, condition) of each kind of evidence, with its ``keep`` columns; pairs may repeat."""
    kind, keep = F.col("kind"), list(keep)
    sizes = measure(
        conditions, paths=F.count_if(kind == AT_PATH), markers=F.count_if((kind == AT_PATH) & F.col("content_contains").isNotNull()),
        texts=F.count_if(kind == IN_TEXT), of_rows=F.count_if(kind == IN_ROW), looks=F.count_if(kind == LOOKED),
        plugins=F.count_if(kind == PLUGIN), look_chars=_chars(kind == LOOKED, "source"), plugin_chars=_chars(kind == PLUGIN, "plugin"),
    )
    hits = []
    if evidence.entries is not None:
        entries = _with_columns(evidence.entries, {"content": "string", "size_bytes": "bigint"})
        if sizes["paths"] or sizes["looks"]:
            hits.append(_entry_hits(entries, conditions, sizes, limits, keep))
        if sizes["texts"]:
            wanted = conditions.where(kind == IN_TEXT).select("__cond", "content_contains", F.col("size_bytes").alias("__size"))
            found = content_hits(entries, wanted, keep=["run_id", *keep, "size_bytes"], limits=limits)
            hits.append(found.where("__size IS NULL OR size_bytes = __size").select("run_id", *keep, "__cond"))
    if evidence.rows is not None and sizes["of_rows"]:
        wanted = conditions.where(kind == IN_ROW).select("__cond", "plugin", "attrs")
        hits.append(process_hits(evidence.rows, wanted, limits, keep))
    if evidence.rows is not None and sizes["plugins"]:
        wanted = conditions.where(kind == PLUGIN).select("__cond", "plugin")
        seen = evidence.rows.select("run_id", *keep, "plugin")
        seen = seen if seen.isStreaming else seen.distinct()
        small = fits(sizes["plugins"], sizes["plugin_chars"], limits.broadcast_rows)
        hits.append(seen.join(F.broadcast(wanted) if small else wanted, "plugin").select("run_id", *keep, "__cond"))
    return hits


def condition_bits(evidence: Evidence, conditions: DataFrame, limits: Limits = Limits()) -> DataFrame | None:
    """For each run a map from the number of a word to its 64 bits; None without evidence."""
    hits = condition_hits(evidence, conditions, limits)
    if not hits:
        return None
    bit = F.expr("shiftleft(1L, CAST(pmod(__cond, 64) AS INT))")
    words = (
        reduce(DataFrame.union, hits)
        .groupBy("run_id", F.shiftright("__cond", 6).alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    # At most a row for each 64 conditions of a run.
    return words.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__bits"))


def _is_set(number: Column) -> Column:
    word = F.try_element_at(F.col("__bits"), F.shiftright(number, 6))
    at = F.pmod(number, F.lit(64)).cast("int")
    return F.coalesce(F.call_function("shiftright", word, at).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def findings_in_one_pass(
    expected: DataFrame,
    evidence: Evidence,
    definitions: DataFrame | None = None,
    limits: Limits = Limits(),
    every_look: bool = False,
) -> DataFrame:
    """``expected`` with ``matched`` and ``assessed``, from one pass over each kind of evidence.

    ``assessed`` says whether the run was looked at from any of the indicator's
    sources (any source if it names none), or by its plugin. It is asked of
    absences only unless ``every_look`` is set; other indicators are then assessed.
    """
    conditions = numbered_conditions(expected if definitions is None else definitions, every_look)
    bits = condition_bits(evidence, conditions, limits)
    columns = expected.columns
    if bits is None:
        return expected.withColumns({"matched": F.lit(False), "assessed": F.lit(not every_look)})
    told = with_conditions(expected, conditions, expected if definitions is None else definitions, limits, every_look)
    return findings_of_bits(told.join(bits, "run_id", "left"), columns, every_look)


def _is_absent() -> Column:
    return F.coalesce(F.col("exists") == F.lit(False), F.lit(False))


def with_conditions(
    expected: DataFrame, conditions: DataFrame, definitions: DataFrame, limits: Limits = Limits(), every_look: bool = False
) -> DataFrame:
    """``expected`` with the number of its condition, ``__cond``, and those of its looks, ``__looks``."""
    numbers = conditions.select("__key", "__cond")
    looks = F.transform(_looks() if every_look else F.when(_is_absent(), _looks()), lambda c: _key(c))
    asked = expected.withColumns({"__key": _key(_main_condition()), "__look": looks})
    defined = definitions.select(looks.alias("__look")).where("__look IS NOT NULL").distinct()
    # Each distinct list of looks with its numbers.
    lists = (
        defined.select("__look", F.explode("__look").alias("__key")).join(numbers, "__key")
        .groupBy("__look").agg(F.collect_list("__cond").alias("__looks"))
    )
    sizes = (limits.broadcast_rows, limits.rows_per_task)
    told = checked_join(asked, numbers, ["__key"], "left", ["run_id"], *sizes)
    return checked_join(told, lists, ["__look"], "left", ["run_id"], *sizes).drop("__key", "__look")


def findings_of_bits(seen: DataFrame, columns: Sequence[str], every_look: bool = False) -> DataFrame:
    """``columns`` of indicators with conditions and their run's ``__bits``, ``matched`` and ``assessed``."""
    absent = _is_absent()
    found = _is_set(F.col("__cond"))
    looked = F.coalesce(F.exists("__looks", lambda n: _is_set(n)), F.lit(False))
    assessed = looked if every_look else F.when(absent, looked).otherwise(F.lit(True))
    matched = F.when(absent, F.col("__cond").isNotNull() & looked & ~found).otherwise(found)
    return seen.select(*columns, matched.alias("matched"), assessed.alias("assessed"))


# --- detection -----------------------------------------------------------------------------

# Takes what each run was to show, the same indicators without their runs, and
# the evidence; gives (run, indicator) pairs.
Matcher = Callable[[DataFrame, DataFrame, Evidence], DataFrame]


def match_files(expected: DataFrame, definitions: DataFrame, evidence: Evidence) -> DataFrame:
    """File indicators: by path, by content alone, or by absence."""
    if evidence.entries is None:
        return _no_pairs(expected)
    to_exist = "coalesce(`exists`, true)"
    positive, defined = expected.where(to_exist), definitions.where(to_exist)
    absent = match_absent_iocs(evidence.entries, expected, definitions)
    return (
        match_file_iocs(evidence.entries, positive, defined)
        .union(match_content_iocs(evidence.entries, positive, defined))
        .union(absent.where("matched").select("run_id", *IOC_KEY))
    )


def match_processes(expected: DataFrame, definitions: DataFrame, evidence: Evidence) -> DataFrame:
    """Process indicators, by the rows of the plugin they name."""
    if evidence.rows is None:
        return _no_pairs(expected)
    return match_process_iocs(evidence.rows, expected, definitions)


# Matcher by indicator type; a new type is a DataFrame function added here or
# passed to ``detect_iocs``.
MATCHERS: dict[str, Matcher] = {"file": match_files, "process": match_processes}


def detect_iocs(
    expected: DataFrame,
    evidence: Evidence,
    definitions: DataFrame | None = None,
    matchers: dict[str, Matcher] | None = None,
) -> DataFrame:
    """One finding per run and expected indicator.

    Indicators are of a file or of a process; of another type none match. All
    are decided in one pass (``findings_in_one_pass``), so repeated evidence never
    repeats a finding. With ``matchers`` indicators go to the matcher of their
    type instead, and (run, indicator) pairs meet the expected ones.
    """
    definitions = expected if definitions is None else definitions
    key = ["run_id", *IOC_KEY]
    if matchers is None:
        findings = findings_in_one_pass(expected, evidence, definitions)
        return findings.select(*key, "ordinal", "type", "matched")
    of = lambda df, kind: df.where(F.col("type") == kind)
    pairs = [
        match(of(expected, kind), of(definitions, kind), evidence).select(*key)
        for kind, match in matchers.items()
    ]
    findings = expected.select(*key, "ordinal", "type")
    if not pairs:
        return findings.withColumn("matched", F.lit(False))
    matched = reduce(DataFrame.union, pairs).distinct().withColumn("__matched", F.lit(True))
    return findings.join(matched, key, "left").select(
        *key, "ordinal", "type", F.col("__matched").isNotNull().alias("matched")
    )


def expected_at_level(steps: DataFrame) -> DataFrame:
    """Indicators to expect at each evasion level of a scenario."""
    return (
        steps.select("scenario_id", F.explode("evasion_levels").alias("level"), "expected_iocs")
        .select("scenario_id", "level", F.explode("expected_iocs.id").alias("ioc_id"))
        .distinct()
    )


def active_steps(steps: DataFrame) -> DataFrame:
    """Steps of a scenario that run at each evasion level."""
    return (
        steps.select("scenario_id", F.explode("evasion_levels").alias("level"))
        .groupBy("scenario_id", "level")
        .agg(F.count("*").alias("n_steps"))
    )


# --- what is expected at a level ---------------------------------------------------------

EXPECTED, NOT_EXPECTED, NOT_ASSESSED = "expected", "not_expected", "not_assessed"


def level_grid(steps: DataFrame, iocs: DataFrame) -> DataFrame:
    """Each indicator of a scenario at each of its evasion levels, and its ``presence``.

    ``expected`` where a step that runs at the level expects the indicator,
    ``not_expected`` where only steps of other levels do, ``not_assessed`` where
    no step speaks of it. ``steps`` and ``iocs`` are those of scenario documents,
    placeholders filled; a level counts if any step runs at it.
    """
    levels = steps.select("scenario_id", F.explode("evasion_levels").alias("level")).distinct()
    # At most as many lists of levels as a scenario has steps.
    claims = (
        steps.select("scenario_id", F.explode("expected_iocs.id").alias("ioc_id"), "evasion_levels")
        .groupBy("scenario_id", "ioc_id")
        .agg(F.flatten(F.collect_set("evasion_levels")).alias("__claimed"))
    )
    presence = (
        F.when(F.array_contains("__claimed", F.col("level")), EXPECTED)
        .when(F.col("__claimed").isNotNull(), NOT_EXPECTED)
        .otherwise(NOT_ASSESSED)
    )
    # Spark takes what is exploded from documents for small and would broadcast it.
    return (
        iocs.join(levels.hint("merge"), "scenario_id")
        .join(claims.hint("merge"), ["scenario_id", "ioc_id"], "left")
        .withColumn("presence", presence)
        .drop("__claimed")
    )


def findings_at_level(
    runs: DataFrame, grid: DataFrame, evidence: Evidence, limits: Limits = Limits()
) -> DataFrame:
    """Findings of runs (run_id, scenario_id, level) against the grid, with an ``outcome``.

    ``found`` and ``missed`` of what was expected, ``unexpected`` and ``absent`` of
    what was not; ``not_assessed`` where no step speaks of the indicator, or the run
    has no evidence to tell it from, or its type is one that nothing tells. The grid
    is written once, as conditions, looks and findings each read it.
    """
    path = work_path(grid.sparkSession, "grid")
    grid.write.parquet(path)
    grid = grid.sparkSession.read.schema(grid.schema).parquet(path)
    expected = runs.join(grid.hint("merge"), ["scenario_id", "level"])
    findings = findings_in_one_pass(expected, evidence, grid, limits, every_look=True)
    found, due = F.col("matched"), F.col("presence") == EXPECTED
    outcome = (
        F.when((F.col("presence") == NOT_ASSESSED) | ~F.col("assessed"), NOT_ASSESSED)
        .when(due & found, "found").when(due, "missed").when(found, "unexpected").otherwise("absent")
    )
    return findings.select(
        "run_id", *IOC_KEY, "level", "ordinal", "type", "presence", "assessed", "matched", outcome.alias("outcome")
    )
