"""Lenient casts: cells that do not parse become NULL and are listed, the job goes on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "_bad_cells"


def checked(df: DataFrame, parsed: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add ``{name: (text column, parsed value)}`` and ``_bad_cells``, the cells that failed.

    ``parsed`` values are NULL where the text is bad (``try_cast`` and the like). A cell is
    bad if it has text and its value is NULL; a NULL text is missing, not bad.
    """
    cells = [
        F.when(F.col(text).isNotNull() & value.isNull(), F.struct(F.lit(text).alias("column_name"), F.col(text).cast("string").alias("text")))
        for text, value in parsed.values()
    ]
    found = F.array_compact(F.array(*cells))
    return df.select(*[c for c in df.columns if c not in parsed], *[value.alias(n) for n, (_, value) in parsed.items()], found.alias(BAD))


def casts(types: Mapping[str, str]) -> dict[str, tuple[str, Column]]:
    """What :func:`checked` needs to cast the columns in place."""
    return {name: (name, F.col(name).try_cast(kind)) for name, kind in types.items()}


def good_rows(rows: DataFrame) -> DataFrame:
    """All checked rows, bad cells NULL."""
    return rows.drop(BAD)


def bad_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, column_name, text) of every bad cell."""
    return rows.where(F.size(BAD) > 0).select(*keys, F.explode(BAD).alias("_cell")).select(*keys, "_cell.*")


def write_checked(rows: DataFrame, path: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Write checked rows once and the bad cells aside; returns both as stored tables.

    The source is read once: the bad cells are taken from the rows as written.
    """
    spark = rows.sparkSession
    rows.write.mode("error").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    bad_cells(stored, keys).write.mode("error").parquet(f"{path}/quarantine")
    return good_rows(stored), spark.read.parquet(f"{path}/quarantine")
