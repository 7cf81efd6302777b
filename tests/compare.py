"""Runs a registered query and its SQL twin and compares them value by value."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def database(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value
    return value


def sortable(row):
    return [(v is not None, str(type(v)), str(v)) if not isinstance(v, (int, float)) else (True, "number", f"{v:.6f}") for v in row]


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=sortable)


def same(df, relation):
    """None if equal, otherwise the first difference."""
    ours = table_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = table_of(relation.columns, relation.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if repr(a) != repr(b):
            return f"{ours[0]}: {a} != {b}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    for name, kind in zip(relation.columns, relation.types):
        pair = (types[name], str(kind))
        if pair not in {("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN")}:
            return f"type of {name}: {pair}"
    return None
