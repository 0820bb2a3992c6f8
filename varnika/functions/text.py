"""Pure Column functions over strings. None needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes as white space.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0  -     　]"
#: Texts that count as missing when a CSV is read in the compatible way.
NA_SET = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def na_compat(c: Column) -> Column:
    """Null for texts that count as missing."""
    return F.when(~c.isin(NA_SET), c)


def as_text(c: Column, missing: str | None = "nan") -> Column:
    """Any value as a string; a missing one as that word (None: stays null)."""
    return c.cast("string") if missing is None else F.coalesce(c.cast("string"), F.lit(missing))


def strip_ws(c: Column) -> Column:
    """Without Unicode white space at both ends; U+200B stays."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def chars(c: Column) -> Column:
    """The code points of a string; none for the empty string."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def wrap(c: Column) -> Column:
    """Between the start and end sentinels."""
    return F.concat(F.lit("^"), c, F.lit("$"))


def unwrap(c: Column) -> Column:
    """Without end sentinels at both ends."""
    return F.regexp_replace(c, r"^\$+|\$+$", "")


def byte_distance(guess: Column, truth: Column) -> Column:
    """Edits between the UTF-8 bytes of two strings."""
    latin = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(latin(guess), latin(truth))


def edit_distance(guess: Column, truth: Column) -> Column:
    """Byte edits over the truth's bytes: 0 for two empty strings, infinity for an empty truth alone."""
    n = F.octet_length(truth)
    some = F.when(F.octet_length(guess) == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(guess.isNull() | truth.isNull(), F.lit(None).cast("double")).when(n == 0, some).otherwise(byte_distance(guess, truth) / n)


def url_rewrite(c: Column) -> Column:
    """A match page's address to that of its Hindi scorecard."""
    return F.replace(F.replace(c, F.lit("/series/"), F.lit("/hindi/series/")), F.lit("live-cricket-score"), F.lit("full-scorecard"))


def split_words(c: Column) -> Column:
    """Pieces between single spaces; empty ones stay."""
    return F.split(c, " ")


def join_words(words: Column) -> Column:
    """Pieces joined by a space; failed ones (null) as empty."""
    return F.array_join(F.transform(words, lambda x: F.coalesce(x, F.lit(""))), " ")
