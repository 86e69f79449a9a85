"""Canonical JSON: members sorted at every level, no white space, number texts kept."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Number(float):
    """A number that prints as it was written."""

    def __new__(cls, text: str):
        self = super().__new__(cls, 0)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


def _write(v: object) -> str:
    if isinstance(v, _Number):
        return v.text
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_write, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def _one(text: str | None) -> str | None:
    if text is None:
        return "{}"
    try:
        return _write(json.loads(text, parse_int=_Number, parse_float=_Number))
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """Null gives {}; a text that is not JSON gives null. Spark's own to_json keeps member order."""

    def each(part: pd.Series) -> pd.Series:
        return part.map(_one)

    return F.pandas_udf(each, "string")(text)
