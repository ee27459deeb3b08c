"""Small text helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it: blank and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same fold for UTF-8 bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def space_words(col: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE), "")


#: Turns every byte that is not part of an alphanumeric word into a blank; bytes from 0x80 on are word bytes.
ALNUM_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "replace").translate(ALNUM_BYTES).split() if text else []
