import os

import duckdb


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def compare(df, sql, sf):
    """The query's rows against its SQL's, in any order."""
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        if os.path.exists(p := f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    names = [d[0] for d in con.execute(sql).description]
    assert sorted(names) == sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    got = rows(df, df.columns)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
