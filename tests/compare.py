"""Run registered queries next to their SQL and compare rows."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return int(value) if type(value).__name__ == "Decimal" and value == int(value) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = rows_of(columns, result.fetchall())
    assert found[0] == wanted[0], (found[0], wanted[0])
    assert len(found[1]) == len(wanted[1]), (len(found[1]), len(wanted[1]), found[1][:3], wanted[1][:3])
    wrong = [(a, b) for a, b in zip(found[1], wanted[1]) if a != b]
    assert not wrong, wrong[:3]
    return len(found[1])
