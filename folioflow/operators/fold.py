"""Ordered folds over books: one shuffle brings a book's rows together, a task folds many books in each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold_sorted_arrow(rows: DataFrame, keys: list[str], order: list[str], fields: list[T.StructField], fold: Callable[[pa.Table, list[tuple[int, int]]], pa.Table]) -> DataFrame:
    """fold_sorted() of Arrow tables, for rows with arrays: their elements need not become objects to be moved along."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def changes(part: pa.Table | pa.RecordBatch) -> np.ndarray:
            new = np.zeros(max(0, part.num_rows - 1), dtype=bool)
            for k in keys:
                c = part.column(k)
                new |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
            return np.flatnonzero(new) + 1

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(parts)
            starts = [0, *changes(part).tolist()]
            yield from fold(part, list(zip(starts, [*starts[1:], part.num_rows], strict=True))).to_batches()

        # Batches of the open book are put together once, when it ends.
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            if held and any(batch.column(k)[0] != held[-1].column(k)[-1] for k in keys):
                yield from done(held)
                held = []
            at = changes(batch)
            if len(at):
                yield from done([*held, batch.slice(0, int(at[-1]))])
                held, batch = [], batch.slice(int(at[-1]))
            held.append(batch)
        if held:
            yield from done(held)

    schema = T.StructType([*rows.schema.fields, *fields])
    return sorted_by(rows, keys, order).mapInArrow(run, schema)


def sorted_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of one book in one partition, by book and order; those without a book go."""
    return rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).repartition(*keys).sortWithinPartitions(*keys, *order)


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], fields: list[T.StructField], fold: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame]) -> DataFrame:
    """fold(rows, bounds) adds `fields` to whole books; bounds are the books' first and last places in rows sorted by keys and order."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(part: pd.DataFrame) -> pd.DataFrame:
            starts = np.flatnonzero((part[keys] != part[keys].shift()).any(axis=1).to_numpy()).tolist()
            return fold(part, list(zip(starts, [*starts[1:], len(part)], strict=True)))

        # Batches of the open book are put together once, when it ends.
        held: list[pd.DataFrame] = []
        for batch in it:
            if not len(batch):
                continue
            if held and not (batch[keys].iloc[0] == held[-1][keys].iloc[-1]).all():
                yield done(pd.concat(held, ignore_index=True))
                held = []
            open_at = int(len(batch) - (batch[keys] == batch[keys].iloc[-1]).all(axis=1).sum())
            if open_at:
                yield done(pd.concat([*held, batch.iloc[:open_at]], ignore_index=True))
                held = []
            held.append(batch.iloc[open_at:])
        if held:
            yield done(pd.concat(held, ignore_index=True))

    schema = T.StructType([*rows.schema.fields, *fields])
    return sorted_by(rows, keys, order).mapInPandas(run, schema)
