"""Rows of two engines, brought to one form."""

from __future__ import annotations

import math

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def assert_same(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    at = [relation.columns.index(c) for c in cols]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in relation.fetchall())
    assert rows_of(df) == theirs
