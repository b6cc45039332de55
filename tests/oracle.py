"""Runs a registered query and its SQL and compares columns, types and rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in GIVEN:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(frame, con, sql: str) -> list[str]:
    """Differences between a Spark result and its SQL, empty when they agree."""
    problems = []
    relation = con.sql(sql)
    types = dict(zip(relation.columns, (str(t) for t in relation.types)))
    if sorted(frame.columns) != sorted(relation.columns):
        return [f"columns {sorted(frame.columns)} vs {sorted(relation.columns)}"]
    for name, kind in frame.dtypes:
        if SAME_TYPE.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    want = _rows(relation.columns, relation.fetchall())
    if got != want:
        extra, missing = got - want, want - got
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"only Spark: {str(list(extra)[:2])[:600]}; only SQL: {str(list(missing)[:2])[:600]}"
        )
    if not got:
        problems.append("empty result")
    return problems
