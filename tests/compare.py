"""Compare a Spark result with its SQL oracle: columns, types, row count and every value."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

KINDS = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "long",
    "double": "double", "float": "double", "varchar": "string", "string": "string", "date": "date",
    "boolean": "boolean",
}


def duck(sf_dir: str, files: str = "") -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}{files}'")
    return connection


def _plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) and not math.isnan(value) else value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str) -> str | None:
    """None if both give the same table, else what differs."""
    expected = connection.sql(sql)
    have = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    want = {name: KINDS.get(str(kind).lower(), str(kind))
            for name, kind in zip(expected.columns, expected.types)}
    if have != want:
        return f"columns differ: only here {set(have.items()) - set(want.items())}, " \
               f"only in the oracle {set(want.items()) - set(have.items())}"
    ours = _rows(df.columns, df.collect())
    theirs = _rows(expected.columns, expected.fetchall())
    if ours == theirs:
        return None
    return (f"{sum(ours.values())} rows against {sum(theirs.values())}; "
            f"only here {list((ours - theirs).items())[:2]}, "
            f"only in the oracle {list((theirs - ours).items())[:2]}; columns {sorted(have)}")
