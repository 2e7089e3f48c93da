"""The two-variant classifier end to end against its SQL."""
import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_hybrid_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    want = con.execute(entry.oracle_sql()["hybrid_end_to_end"]).fetchall()
    got = [tuple(r) for r in entry.queries()["hybrid_end_to_end"](spark, SF).collect()]
    key = lambda rows: sorted((d, c, round(s, 9), p) for d, c, s, p in rows)
    assert key(got) == key(want)
