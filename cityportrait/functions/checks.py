"""Checks on column names, made before any job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "table") -> DataFrame:
    """Raise ValueError naming the columns that are missing."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"{what} must be a DataFrame")
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def first_present(df: DataFrame, candidates: Iterable[str], what: str = "column") -> str:
    """The first candidate that is a column, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"no {what} among {list(candidates)}")


def choose(value: str, options: Iterable[str], what: str) -> str:
    if value not in options:
        raise ValueError(f"{what} must be one of {list(options)}")
    return value


def split_requested(requested: Iterable[str] | None, available: Iterable[str]) -> tuple[list[str], list[str]]:
    """(variables to score, variables skipped): all available ones, sorted, unless some are asked for."""
    have = set(available)
    if requested is None:
        return sorted(have), []
    wanted = list(dict.fromkeys(requested))
    return [v for v in wanted if v in have], [v for v in wanted if v not in have]
