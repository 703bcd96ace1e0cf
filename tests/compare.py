"""Rows of a Spark query and of DuckDB SQL on the same tables, in one comparable form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([cell(r[i]) for i in order]) for r in data)), sorted(columns)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    expected = rows(want.columns, want.fetchall())
    assert got[1] == expected[1]
    assert len(got[0]) == len(expected[0])
    assert [x.replace(".0", "") for x in got[0]] == [x.replace(".0", "") for x in expected[0]]
