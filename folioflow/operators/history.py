"""Undo and redo over a command log: which command every undo and redo reaches, and which commands hold in the end."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Commands that an undo can reach (fixed value).
LIMIT = 100
COMMAND, UNDO, REDO, CLEAR = "command", "undo", "redo", "clear"


class Stacks:
    """One log's stacks: at most `limit` commands can be undone; the oldest is then beyond reach but holds."""

    def __init__(self, limit: int) -> None:
        self.done: deque = deque(maxlen=limit)
        self.undone: list = []

    def take(self, kind: str, name: object) -> object:
        """The command that an entry concerns, None where it has no effect."""
        if kind == COMMAND:
            self.done.append(name)
            self.undone.clear()
            return name
        if kind == CLEAR:
            self.done.clear()
            self.undone.clear()
            return None
        source, target = (self.done, self.undone) if kind == UNDO else (self.undone, self.done)
        if kind not in (UNDO, REDO) or not source:
            return None
        target.append(source.pop())
        return target[-1]


def replayed(log: DataFrame, keys: list[str], order: list[str], kind: str, name: str, limit: int = LIMIT) -> DataFrame:
    """Adds to every entry of a log `reaches`, the command it concerns, and `depth` and `ahead`, how many can be undone and redone after it.

    kind: command, undo, redo or clear; others, and null, do nothing. name: a long that names commands, unique within a log. A new command
    forgets what was undone; an undo or redo with nothing to reach has no effect. Logs are read in order, an entry at a time:
    a task holds the last `limit` commands of one log, however long the log is. Null keys are a log of their own.
    """
    schema = T.StructType([*log.schema.fields, T.StructField("reaches", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("ahead", T.IntegerType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stacks = None, None
        for batch in it:
            reaches, depth, ahead = [], [], []
            whose = batch[keys].astype(object).where(batch[keys].notna(), None).itertuples(index=False, name=None)
            for key, k, n in zip(whose, batch[kind], batch[name], strict=True):
                if stacks is None or key != at:
                    at, stacks = key, Stacks(limit)
                reaches.append(stacks.take(k, n))
                depth.append(len(stacks.done))
                ahead.append(len(stacks.undone))
            yield batch.assign(reaches=pd.array(reaches, dtype="Int64"), depth=pd.array(depth, dtype="int32"), ahead=pd.array(ahead, dtype="int32"))

    return log.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def live_commands(replay: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """(keys, command) of the commands that hold at the end of each replayed log: not undone, or done again since."""
    last = replay.where("reaches IS NOT NULL").groupBy(*keys, F.col("reaches").alias("command")).agg(F.max_by(kind, F.struct(*order)).alias("_last"))
    return last.where(F.col("_last") != UNDO).drop("_last")
