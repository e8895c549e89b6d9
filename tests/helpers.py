"""Comparing Spark's rows with DuckDB's."""

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def normal(rows):
    """Rows as comparable values, order left out."""

    def one(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0 if v == v else None
        if hasattr(v, "item"):
            return one(v.item())
        return v

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


def duck_rows(sql, sf_dir):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return [got.columns[i] for i in order], normal([[r[i] for i in order] for r in got.fetchall()])


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, normal([tuple(r) for r in df.select(*columns).collect()])
