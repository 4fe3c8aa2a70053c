"""Schema-level helpers. They look at column names only and start no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def present_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` the frame has, in the order of ``names``."""
    have = set(df.columns)
    return [name for name in names if name in have]


def find_column(columns: Sequence[str], name: str) -> str | None:
    """The existing column meant by ``name``: itself, any other case, or a known spelling."""
    if name in columns:
        return name
    same = [c for c in columns if c.lower() == name.lower()]
    if same:
        return same[-1]
    spellings = (name.replace("_", ""), name.title().replace("_", ""), name.upper())
    return next((s for s in spellings if s in columns), None)


def align_columns(
    df: DataFrame, names: Sequence[str], default: float = 0.0
) -> tuple[DataFrame, list[str]]:
    """Give the frame every column in ``names``, NULLs filled with ``default``.

    A column found under another spelling is renamed; one not found becomes the
    constant. Returns the frame and the names that had to be made up, so a silently
    constant input cannot go unnoticed.
    """
    found = {name: find_column(df.columns, name) for name in names}
    made_up = [name for name, column in found.items() if column is None]
    renamed = {column: name for name, column in found.items() if column not in (None, name)}
    aligned = df.select(*[F.col(c).alias(renamed.get(c, c)) for c in df.columns])
    if made_up:
        aligned = aligned.withColumns({name: F.lit(default) for name in made_up})
    return aligned.fillna(default, subset=list(names)), made_up
