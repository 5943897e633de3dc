"""Runs a registered query and its oracle SQL on the same tables and compares the rows."""

import datetime
import decimal
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def connection(sf_dir=SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def compare(spark, query, sql, sf_dir=SF_DIR):
    """(rows, first differences) of the query and its SQL, columns by name."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    result = connection(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns, (sorted(names), columns)
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
    if got == want:
        return len(got), []
    gone, new = [x for x in want if x not in set(got)][:3], [x for x in got if x not in set(want)][:3]
    return len(got), [len(want), {"wanted": gone, "got": new}]
