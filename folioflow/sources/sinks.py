"""Sinks: verified overwrite with a backup, timestamped backups, refusing sinks, JSON reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free hash of a table."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return row[0], row[1]


def hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stamp(at: datetime) -> str:
    return at.strftime("%Y%m%dT%H%M%SZ")


def save_verified(df: DataFrame, path: str, at: datetime, label: str = "book") -> str | None:
    """save_journaled() without a check of the rows; returns the backup's path."""
    return save_journaled(df, path, at, label=label)


#: States of a save, in order: the new table is being written beside the target; it is whole and takes the target's place; all is done.
TEMP, TARGET, COMPLETE = STATES = ("temp", "target", "complete")


def journal_path(path: str) -> str:
    return f"{path}.journal"


def read_journal(spark: SparkSession, path: str) -> dict | None:
    """The journal of the last save to a path; None where there is none. A journal cut short by a crash is the one before it."""
    fs, at = hadoop(spark, journal_path(path))
    if not fs.exists(at):
        return None
    found = [f.getPath() for f in fs.listStatus(at)]
    entries = []
    for f in found:
        if f.getName().endswith(".json"):
            stream = fs.open(f)
            try:
                entries.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
    return max(entries, key=lambda e: (e["started_at"], STATES.index(e["status"])), default=None)


def write_journal(spark: SparkSession, path: str, entry: dict) -> None:
    """Adds an entry; it is written beside and renamed, so a reader sees it whole or not at all."""
    fs, folder = hadoop(spark, journal_path(path))
    fs.mkdirs(folder)
    name = f"{journal_path(path)}/{entry['started_at']}-{STATES.index(entry['status'])}"
    _, draft = hadoop(spark, f"{name}.draft")
    _, final = hadoop(spark, f"{name}.json")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    stream.close()
    if not fs.exists(final) and not fs.rename(draft, final):
        raise OSError(f"cannot write the journal of {path}")


def save_journaled(df: DataFrame, path: str, at: datetime, label: str = "book", validate: Callable[[DataFrame], DataFrame] | None = None, step: Callable[[str], None] = lambda name: None) -> str | None:
    """Overwrites a table so that a crash at any point loses neither the old rows nor the new ones.

    validate gives messages about df; any with severity 'error' refuses the save. The journal says first that the new table is
    being written beside the target; once it reads back with the same rows the journal says so, the old table becomes a
    backup and the new one takes its place; then the save is complete. After a crash recover() finishes what had come so far or
    drops it. An unfinished save to the same path is recovered first. step is called after every step, by name. Returns the backup's path.
    """
    spark = df.sparkSession
    if validate is not None and validate(df).where("severity = 'error'").limit(1).count():
        raise ValueError("the table has errors and is not saved")
    recover(spark, path)
    entry = {"version": 1, "status": TEMP, "started_at": stamp(at), "staging": f"{path}.staging-{stamp(at)}", "backup": f"{path}.backups/{label}_{stamp(at)}", "target": path}
    write_journal(spark, path, entry)
    step("journal temp")
    fs, new = hadoop(spark, entry["staging"])
    df.write.mode("errorifexists").parquet(entry["staging"])
    step("staging written")
    rows = fingerprint(spark.read.schema(df.schema).parquet(entry["staging"]))
    if fingerprint(df) != rows:
        fs.delete(new, True)
        write_journal(spark, path, entry | {"status": COMPLETE, "outcome": "dropped"})
        raise OSError("the written table reads back differently")
    write_journal(spark, path, entry | {"status": TARGET, "rows": list(rows)})
    step("journal target")
    return finish(spark, path, entry | {"status": TARGET, "rows": list(rows)}, step)


def finish(spark: SparkSession, path: str, entry: dict, step: Callable[[str], None] = lambda name: None) -> str | None:
    """The renames of a save whose new table is whole; each is left out where it has been made, so it can be called again."""
    fs, new = hadoop(spark, entry["staging"])
    _, old = hadoop(spark, path)
    _, kept = hadoop(spark, entry["backup"])
    if fs.exists(new):
        if fs.exists(old):
            fs.mkdirs(kept.getParent())
            if not fs.rename(old, kept):
                raise OSError(f"no backup at {entry['backup']}")
            step("old table moved")
        if not fs.rename(new, old):
            raise OSError(f"cannot move the new table to {path}")
        step("new table moved")
    if list(fingerprint(spark.read.parquet(path))) != entry["rows"]:
        raise OSError(f"{path} reads back differently; the old table is at {entry['backup']}")
    write_journal(spark, path, entry | {"status": COMPLETE, "outcome": "saved"})
    step("journal complete")
    return entry["backup"] if fs.exists(kept) else None


def recover(spark: SparkSession, path: str) -> str:
    """Brings a path back in order after a crash; says what it did: 'nothing', 'dropped' (the old table stays) or 'saved' (the new one is in place).

    Whatever step a save had come to, the table is then either the old or the new one, whole. Recovering twice does nothing more.
    """
    entry = read_journal(spark, path)
    if entry is None or entry["status"] == COMPLETE:
        return "nothing"
    if entry["status"] == TARGET:
        finish(spark, path, entry)
        return "saved"
    fs, new = hadoop(spark, entry["staging"])
    fs.delete(new, True)
    write_journal(spark, path, entry | {"status": COMPLETE, "outcome": "dropped"})
    return "dropped"


def save_candidate(df: DataFrame, report: DataFrame, folder: str, validate: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, str | None]:
    """Writes a migrated book beside the one that is there, with its report, and a copy of the old one; the book itself stays as it is.

    Errors that validate finds refuse it. Each of the three is written beside its place and renamed, and replaces the one of an earlier
    try; names of what was written are returned, the backup's is None where there is no book yet.
    """
    spark = df.sparkSession
    if validate is not None and validate(df).where("severity = 'error'").limit(1).count():
        raise ValueError("the candidate has errors and is not saved")
    names = {"candidate": "book_v4_candidate", "report": "migration_report", "backup": "book_old_backup"}
    fs, book = hadoop(spark, f"{folder}/book")
    parts = {"candidate": df, "report": report}
    if fs.exists(book):
        parts["backup"] = spark.read.parquet(f"{folder}/book")
    for what, table in parts.items():
        place = f"{folder}/{names[what]}"
        draft = f"{place}.draft"
        writer = table.write.mode("overwrite")
        writer.json(draft) if what == "report" else writer.parquet(draft)
        _, new = hadoop(spark, draft)
        _, old = hadoop(spark, place)
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"cannot write {place}")
    return {what: f"{folder}/{name}" if what in parts else None for what, name in names.items()}


def restore(spark: SparkSession, backup: str, path: str, at: datetime, label: str = "registry") -> str | None:
    """Puts a backup's rows in place of a table by a journaled save; the backup stays, and what was there becomes one. Returns that one's path."""
    return save_journaled(spark.read.parquet(backup), path, at, label=label)


def save_new(df: DataFrame, path: str) -> None:
    """Refuses an existing target."""
    df.write.mode("errorifexists").parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, in as many files as it has partitions."""
    df.write.mode("overwrite").json(path)


def launcher(title: str, book_id: str) -> str:
    """A small HTML page that opens a book."""
    from html import escape

    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><a href="../../reader/index.html?book={escape(book_id)}">{escape(title)}</a>'
