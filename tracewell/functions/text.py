"""Lines, words and JSON in texts, by Unicode rules.

The checksum lists and logs come from tools whose readers treat every Unicode
line break and space alike, while Java's ``\\s`` knows only ASCII. The characters
are first made plain, one for one; what follows is then done by Spark's fast
functions on single characters, without regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode line boundaries besides the newline, and other white
# space besides the blank.
LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SPACES = (
    "\t\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)


def plain_lines(text: Column) -> Column:
    """Lines of a text, broken at any Unicode line boundary.

    White space in a line becomes blanks, and none is left at its ends.
    """
    single = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    plain = F.translate(
        single, LINE_BREAKS + SPACES, "\n" * len(LINE_BREAKS) + " " * len(SPACES)
    )
    return F.transform(F.split(plain, "\n"), lambda line: F.trim(line))


def strip_space(text: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.btrim(text, F.lit("\n " + LINE_BREAKS + SPACES))


# Lets the JSON reader take a string of any length.
LONG_STRINGS = {"maxStringLen": "2147483647"}


def is_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value, of any size; null for null.

    Spark's parser stops after the first value and would pass over what follows
    it. Here the text is put in front of its own hash in an array: only a
    single, complete value leaves the hash in second place. The values stay text,
    so no limit of a parsed value applies to the document.
    """
    mark = F.xxhash64(text).cast("string")
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")), "array<string>", LONG_STRINGS)
    # Under a name, as Spark would parse the text again for each use.
    found = F.exists(F.array(pair), lambda p: (F.size(p) == 2) & (F.get(p, F.lit(1)) == mark))
    return F.when(text.isNotNull(), (strip_space(text) != "") & F.coalesce(found, F.lit(False)))


def json_value(text: Column) -> Column:
    """Text as a variant, null unless it is exactly one JSON value.

    For small documents: a variant holds at most 128 MiB, a string in it 20 million
    characters.
    """
    mark = F.xxhash64(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    return F.when(
        F.try_variant_get(pair, "$[1]", "bigint") == mark, F.try_variant_get(pair, "$[0]", "variant")
    )
