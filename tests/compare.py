"""Rows of a query against rows of its oracle in DuckDB."""

import math
import os

import duckdb

ROOT = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/*.parquet' )" if os.path.isdir(at) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(rows):
    names = sorted(rows[0]) if rows else []
    return names, sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)


def check(df, sql, sf_dir):
    ours, theirs = table([r.asDict() for r in df.collect()]), table(oracle_rows(sql, sf_dir))
    assert sorted(df.columns) == (theirs[0] or sorted(df.columns))
    assert len(ours[1]) == len(theirs[1]), (len(ours[1]), len(theirs[1]))
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    assert not wrong, (ours[0], wrong[:3], len(wrong))
    return len(ours[1])
