"""A registered query and its SQL over small tables of a test's own."""

import duckdb

from vigilia.llm import queries


def rows_of(frame_rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame_rows), key=repr)


def equal_to_sql(spark, folder, name, **tables):
    """Write ``tables`` as Parquet; the query's rows, checked against its SQL."""
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    cursor = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    want = [dict(zip([c[0] for c in cursor.description], r)) for r in cursor.fetchall()]
    assert sorted(got.columns) == columns
    rows = got.collect()
    assert rows_of(rows, columns) == rows_of(want, columns)
    return rows
