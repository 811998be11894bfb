"""A query's rows beside those of its SQL, compared as the driver does: columns by name, rows in any order."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return "null" if x is None or x != x else f"{x:.10g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert shown(df.columns, [tuple(r) for r in df.collect()]) == shown(columns, found.fetchall())
