"""Text lists and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import json_value, plain_lines, strip_marker, strip_space


def checksum_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per listed file: line_no, hash and file_name.

    The hash is a line's first word, the file name its last; lines with fewer
    than two words are skipped. ``first_match`` picks the line that counts when
    a file is listed twice.
    """
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(plain_lines(F.col(text))).alias("line_no", "__line"))
    return lines.where(F.contains("__line", F.lit(" "))).select(
        *rest,
        "line_no",
        F.lower(F.substring_index("__line", " ", 1)).alias("hash"),
        strip_marker(F.substring_index("__line", " ", -1)).alias("file_name"),
    )


def run_log_payload(stdout: Column, guid: Column) -> Column:
    """What follows the guid on the first log line that has something there."""
    lines = F.transform(F.split(stdout, "\n"), strip_space)
    tails = F.transform(
        F.filter(lines, lambda line: (line != "") & line.startswith(guid)),
        lambda line: strip_space(F.substr(line, F.length(guid) + 1)),
    )
    return F.get(F.filter(tails, lambda tail: tail != ""), F.lit(0))


def parse_run_log(df: DataFrame, stdout: str, guid: str) -> DataFrame:
    """Adds ``payload`` and ``result``, the JSON a run printed after its guid.

    A line with the guid alone is passed over; the first one with more decides,
    and if that is no JSON the result is null.
    """
    return df.withColumn("payload", run_log_payload(F.col(stdout), F.col(guid))).withColumn(
        "result", json_value(F.col("payload"))
    )
