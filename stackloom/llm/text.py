"""Column expressions over texts that several native operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def split_plain_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), "")


def places(count: Column, length: int) -> Column:
    """0-based places at which a run of ``length`` fits into ``count`` elements."""
    return F.when(count >= length, F.sequence(F.lit(0), count - length)).otherwise(F.array().cast("array<int>"))


def run_hashes(hashes: Column, count: Column, length: int) -> Column:
    """Hash of every run of ``length`` elements of an array of hashes."""
    return F.transform(places(count, length), lambda i: F.xxhash64(*[hashes[i + j] for j in range(length)]))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
