"""Quality rules whose thresholds come from the corpus, in DataFrame functions only.

Method: a few rates are measured for each text. Per language and source, each
rate goes into a quantile sketch: counts of buckets whose width grows with the
value (a relative error of 1/32), so two sketches merge by adding counts and the
result is the same in any order. A text passes if none of its rates lies above
the upper outer fence of its group, q3 + 3 (q3 - q1), plus a least spread.
Groups with few texts take the sketch of their language, or of everything, which
are sums of the finer ones. The fences are joined back to the texts.

Defined cases: a null text has no words and fails. A null language or source is a
group of its own. Repeated rows are judged one by one, each alike. All columns
of the input are carried along; the measured values are one struct column. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import as_row, from_row, spread, whole, written
from tracewell.llm.textops import SPACE_CHARS

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Fixed rules, applied before the adaptive ones.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW_WORDS = 5

# Rates as whole numbers, and the spread that every group is granted: shares in
# 1/10,000, the mean word in 1/100 of a character.
SPREAD = {"symbols": 200, "capitals": 2000, "repeated_lines": 3000, "word_length": 150}

# Groups of fewer texts use the sketch above them.
MIN_GROUP = 200

# Buckets of one octave, as a power of two.
OCTAVE_BITS = 5


def pairs(values: Column, apart: int, n: Column, join) -> Column:
    """``join`` of each element with the one ``apart`` places on; n results."""
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(apart + 1), n), join)


def measured(df: DataFrame, text: Column) -> DataFrame:
    """The columns of ``df`` and a struct ``measures`` of what the rules look at.

    Everything is computed inside the row, so a text is never taken apart into
    rows and nothing is shuffled.
    """
    body = whole(text)
    blanks = F.translate(body, SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    n_chars = lambda c: F.length(c).cast("long")
    without = lambda chars: n_chars(body) - n_chars(F.translate(body, chars, ""))
    count = F.size("__words")
    room = F.greatest(count - (WINDOW_WORDS - 1), F.lit(0))
    hashed = df.withColumn("__words", F.filter(F.split(blanks, " "), lambda w: w != "")).withColumn(
        "__hash", F.transform("__words", lambda w: F.xxhash64(w))
    )
    # Hashes of 5 words, joined as 1 + 1, 2 + 2, 4 + 1.
    two = pairs(F.col("__hash"), 1, F.greatest(count - 1, F.lit(0)), lambda a, b: F.xxhash64(a, b))
    hashed = hashed.withColumn("__two", two)
    four = pairs(F.col("__two"), 2, F.greatest(count - 3, F.lit(0)), lambda a, b: F.xxhash64(a, b))
    hashed = hashed.withColumn("__four", four)
    five = F.zip_with(
        F.slice("__four", F.lit(1), room), F.slice("__hash", F.lit(WINDOW_WORDS), room), lambda a, b: F.xxhash64(a, b)
    )
    hashed = hashed.withColumn("__five", five)
    # Places of windows that are found twice: neighbours in order of the hash.
    placed = F.sort_array(F.transform("__five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("__placed", F.when(F.size(F.array_distinct("__five")) < F.size("__five"), placed))
    twice = pairs(
        F.col("__placed"), 1, F.greatest(F.size("__placed") - 1, F.lit(0)),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(F.array_distinct(F.flatten(twice)), lambda i: F.sequence(i, i + (WINDOW_WORDS - 1))))
    )
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    hashed = hashed.withColumn("__lines", lines)
    values = F.struct(
        count.cast("long").alias("n_words"),
        (n_chars(F.translate(body, SPACE_CHARS, ""))).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__placed").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        without(UPPER).alias("n_capitals"),
    )
    return hashed.select(*[F.col(f"`{c}`") for c in df.columns], values.alias("measures"))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])


def rates() -> dict[str, Column]:
    of = lambda top, scale, bottom: F.expr(f"CASE WHEN measures.{bottom} > 0 THEN ({scale} * measures.{top}) div measures.{bottom} ELSE 0L END")
    return {
        "symbols": of("n_symbols", 10000, "word_chars"),
        "capitals": of("n_capitals", 10000, "word_chars"),
        "repeated_lines": of("n_dup_lines", 10000, "n_lines"),
        "word_length": of("word_chars", 100, "n_words"),
    }


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number: exact when small, then 1/32 wide."""
    small = 1 << (OCTAVE_BITS + 1)
    shift = F.length(F.bin(value)) - (OCTAVE_BITS + 1)
    high = shift.cast("long") * (1 << OCTAVE_BITS) + F.floor(value / F.pow(F.lit(2.0), shift)).cast("long")
    return F.when(value < small, value.cast("long")).otherwise(high)


def floor_of(b: Column) -> Column:
    """The smallest value in a bucket."""
    size = 1 << OCTAVE_BITS
    high = ((b % size) + size) * F.pow(F.lit(2.0), F.floor(b / size) - 1)
    return F.when(b < 2 * size, b).otherwise(high.cast("long"))


def fences(sketch: DataFrame, keys: list[str], spreads: dict[str, int]) -> DataFrame:
    """Per group: how many texts, and the upper outer fence of each rate."""
    group = Window.partitionBy(*keys, "rate")
    so_far = F.sum("n").over(group.orderBy("bucket"))
    ranked = sketch.select("*", so_far.alias("upto"), F.sum("n").over(group).alias("all"))
    at = lambda k: floor_of(F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket"))))
    least = F.coalesce(*[F.when(F.col("rate") == r, F.lit(s)) for r, s in spreads.items()])
    quartiles = ranked.groupBy(*keys, "rate").agg(F.max("all").alias("texts"), at(1).alias("q1"), at(3).alias("q3"))
    fence = F.col("q3") + 3 * (F.col("q3") - F.col("q1")) + least
    wide = [F.max(F.when(F.col("rate") == r, fence)).alias(r) for r in spreads]
    return quartiles.groupBy(*keys).agg(F.max("texts").alias("texts"), *wide)


def thresholds(measures: DataFrame, spreads: dict[str, int] = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """Fences of every (lang, source) that has a text passing the fixed rules."""
    rate = rates()
    passing = measures.where(~base_failed(F.col("measures")))
    rows = passing.select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(rate[r]).alias("bucket")) for r in spreads])).alias("r"),
    )
    fine = rows.groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count("*").alias("n"))
    merged = lambda *keys: fine.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    own = fences(fine, ["lang", "source"], spreads)
    by_lang = fences(merged("lang"), ["lang"], spreads)
    overall = fences(merged().withColumn("some", F.col("n") > 0), ["some"], spreads)
    of = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    joined = (
        own.join(of(by_lang, "l"), own["lang"].eqNullSafe(F.col("l_lang")))
        .join(of(overall, "a"), (F.col("texts") > 0) == F.col("a_some"))
    )
    chosen = lambda r: F.when(F.col("texts") >= min_group, F.col(r)).when(F.col("l_texts") >= min_group, F.col(f"l_{r}")).otherwise(F.col(f"a_{r}"))
    return joined.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[chosen(r).alias(f"most_{r}") for r in spreads])


def judged(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", name: str = "quality",
    spreads: dict[str, int] = SPREAD, min_group: int = MIN_GROUP, keep_text: bool = True,
) -> DataFrame:
    """All rows and columns and a struct ``name``: the measures, base_failed, kept.

    The measures are written once beside the columns of ``df``, as the sketches
    and the verdict both need them; without ``keep_text`` the text is left out.
    """
    columns = [c for c in df.columns if c != name and (keep_text or c != text)]
    rows = spread(df).select(as_row(columns), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    measures = written(measured(rows, F.col("text")).drop("text"), "quality")
    limits = thresholds(measures, spreads, min_group)
    joined = measures.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    fits = F.lit(True)
    for r, rate in rates().items():
        if r in spreads:
            fits = fits & F.coalesce(rate <= F.col(f"most_{r}"), F.lit(False))
    failed = base_failed(F.col("measures"))
    verdict = F.struct("measures.*", failed.alias("base_failed"), (~failed & fits).alias("kept"))
    return joined.select(*from_row(columns), verdict.alias(name))
