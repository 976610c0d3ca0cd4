"""Compare a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    """DuckDB with a view for each given table."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df):
    """Columns in order of name, and rows as sorted texts."""
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(str, r)) for r in df.select(*cols).collect())


def rows_in_sql(con, sql):
    """The same of a DuckDB query."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    cols = sorted(names)
    return cols, sorted(tuple(str(r[names.index(c)]) for c in cols) for r in got.fetchall())
