"""Unique ids by probing against a growing set: an ordered fold over each book."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.operators.fold import fold_sorted


def unique_ids(ids: Iterable[str | None], used: set[str] | None = None, suffix: str = "-{n}") -> list[str]:
    """Each id as it is if it is free, else with the first free number from 2 on; blanks are 'id'."""
    used = set() if used is None else used
    at: dict[str, int] = {}
    out = []
    for raw in ids:
        base = (raw or "").strip() or "id"
        name, n = base, at.get(base, 2)
        while name in used:
            name, n = base + suffix.format(n=n), n + 1
        at[base] = n
        used.add(name)
        out.append(name)
    return out


def ensure_unique(rows: DataFrame, keys: list[str], order: list[str], id_: str, out: str = "unique_id", suffix: str = "-{n}") -> DataFrame:
    """Adds ids that are unique within each key, probed in order, so a literal 'x-2' that stands earlier is respected."""

    def fold(rows: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        ids = rows[id_].tolist()
        return rows.assign(**{out: [x for lo, hi in bounds for x in unique_ids(ids[lo:hi], suffix=suffix)]})

    return fold_sorted(rows, keys, order, [T.StructField(out, T.StringType())], fold)
