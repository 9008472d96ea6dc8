"""Helpers of the llm operators: shared work folders, word tokenisers and checked column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.sequence import placed
from runloom.session import cut_lineage, work_folder

__all__ = ["ASCII_WORDS", "cut_lineage", "ranked", "row_key", "stored", "table", "work_folder", "words_of"]

#: Bytes to lower case for A-Z, separators of benchmark words to a blank; other bytes stay.
ASCII_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    return cut_lineage(df, name)


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters after lower-casing A-Z, as UTF-8 bytes."""
    return text.encode("utf-8", "replace").translate(ASCII_WORDS).split() if text else []


def ascii_lower(column):
    """Lower case of A-Z only; texts of ASCII alone take the faster built-in."""
    other = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(other)


def row_key(docs: DataFrame) -> Column:
    """16 bytes that are equal only for rows that repeat both doc_id and text; nulls differ from all values."""
    parts = [F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in (docs["doc_id"].cast("string"), F.md5(docs["text"].cast("binary")))]
    return F.unhex(F.md5(F.concat(parts[1], parts[0]).cast("binary")))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Rows of df, stored under a name, with their places along (keys, order): see `placed`."""
    return placed(df, keys, order, lambda rows: stored(rows, name))
