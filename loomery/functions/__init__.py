"""Column functions: words, shingles, identifiers, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null is no words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def shingles(tokens: Column, width: int) -> Column:
    """Every run of ``width`` tokens as one string, in order; none if there are fewer.

    ``tokens`` is used once per position: pass a column of an earlier ``select``, not an expression
    that would be computed as often.
    """
    at = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - F.lit(width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(width)), " "))


def turn_id() -> Column:
    """One number for conversation and turn; a turn of 2**20 or more, or below 0, is an error."""
    told = F.when(F.col("turn").between(0, (1 << 20) - 1), F.col("turn").cast("long")).when(F.col("turn").isNotNull(), F.raise_error(F.lit("turn out of range")).cast("long"))
    return F.col("conv_id").cast("long") * (1 << 20) + told


def line_count(text: Column) -> Column:
    """Number of lines; a final line end opens no further line, an empty text has none."""
    parts = F.size(F.split(text, "\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(parts - F.when(text.endswith("\n"), 1).otherwise(0))


def identifier_words(name: Column) -> Column:
    """Words of an identifier, cut at case, digit and punctuation borders, in lower case."""
    cut = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.split(F.lower(cut), r"[^a-z0-9]+"), lambda w: w != "")


def fold_key(name: Column) -> Column:
    """The name without ``_ - $``, in lower case."""
    return F.lower(F.translate(name, "_-$", ""))


def shape_bits(stem: Column) -> Column:
    """Bits of a name's shape: _ 1, - 2, lower case 4, upper case 8, leading digit 16, leading upper case 32, other 64."""
    tests = ["_", "-", "[a-z]", "[A-Z]", "^[0-9]", "^[A-Z]", "[^A-Za-z0-9_-]"]
    out = F.lit(0)
    for bit, pattern in enumerate(tests):
        out = out + F.when(stem.rlike(pattern), 1 << bit).otherwise(0)
    return out
