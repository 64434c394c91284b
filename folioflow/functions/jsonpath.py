"""Values in JSON documents by path: read, set with missing parents, compared in a canonical form."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def path_text(path: Sequence[str | int]) -> str:
    """A path of keys and indexes as a variant path: ['a', 0, 'b c'] is $['a'][0]['b c']."""
    quoted = (f"[{p}]" if isinstance(p, int) else "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)
    return "$" + "".join(quoted)


def get_at(document: Column, path: Sequence[str | int], kind: str = "string") -> Column:
    """The value at a path; null where the document cannot be read, a parent is missing, or the value is of no such kind."""
    return F.try_variant_get(F.try_parse_json(document), path_text(path), kind)


class Unreachable(ValueError):
    """A path leads through a value that holds no others."""


def put(root: object, path: Sequence[str | int], value: object, there: bool) -> object:
    """root with value at path, or without it where not `there`. Containers are changed in place; missing ones are made."""
    key, rest = path[0], path[1:]
    if root is None or isinstance(root, (str, bool, int, float)):
        raise Unreachable(key)
    if isinstance(root, list):
        if not isinstance(key, int) or key < 0:
            raise Unreachable(key)
        root.extend([None] * (key + 1 - len(root)) if rest or there else [])
    else:
        key = str(key)
    has = key < len(root) if isinstance(root, list) else key in root
    if rest:
        # What is missing becomes an array or an object, by the key that follows.
        old = root[key] if has and (root[key] is not None or isinstance(root, dict)) else ([] if isinstance(rest[0], int) else {})
        root[key] = put(old, rest, value, there)
    elif there:
        root[key] = value
    elif isinstance(root, dict):
        root.pop(key, None)
    elif has:
        root[key] = None
    return root


def set_at_path(document: Column, path: Sequence[str | int], value: Column) -> Column:
    """The document with a value (JSON text) at a path of keys (str) and indexes (int, from 0).

    Parents that are missing are made: an array where an index follows, else an object; arrays grow by nulls. A null
    value takes a key out of an object and leaves null in an array. Null where document or value is no JSON, or where the
    path leads through a null, a text or a number, or by a key into an array. Object keys keep their order, new ones stand last.
    One Arrow batch at a time goes to Python: Spark's variants are read only.
    """
    steps = list(path)
    if not steps:
        raise ValueError("an empty path names no place")

    def run(documents: pd.Series, values: pd.Series) -> pd.Series:
        def one(text: str | None, new: str | None) -> str | None:
            try:
                root = json.loads(text) if text is not None else None
                out = put(root, steps, json.loads(new) if new is not None else None, new is not None)
            except ValueError:  # no JSON, or Unreachable
                return None
            return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(t, v) for t, v in zip(documents, values, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(document, value)


def canonical(document: Column) -> Column:
    """JSON with its keys sorted and no white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(document))


def equal(a: Column, b: Column) -> Column:
    """Whether two documents hold the same values, whatever the order of their keys; two that cannot be read are not equal."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))
