"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainguard.session import new_folder

# The characters that part words, and words themselves, as the contracts state them.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SHINGLE = 5
SIMILAR_PERCENT = 75


def without(df: DataFrame, *added: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to add; the operator's own win."""
    names = {name.lower() for name in added}
    return df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() not in names))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def words(text: Column) -> Column:
    """Array of the words of ``text``, unchanged; NULL and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(data: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; NULL counts as empty."""
    return F.crc32(F.coalesce(data, F.lit("")).cast("binary"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back, with a size that the planner knows."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
