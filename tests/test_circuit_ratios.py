"""a33 keeps suppliers that never carry a load, as its SQL does, and moves no more rows than it must."""

import duckdb

import __spark_entry__ as entry


def test_idle_supplier_keeps_its_row(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW src AS SELECT * REPLACE (CASE WHEN l_suppkey = 1 THEN least(l_quantity, 5) ELSE l_quantity END AS l_quantity) FROM '/root/testdata/sf0.001/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM src) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    cur = con.execute(entry.oracle_sql()["a33_circuit_ratios"])
    cols = [d[0] for d in cur.description]
    got = sorted((tuple(r[c] for c in cols) for r in entry.queries()["a33_circuit_ratios"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr) and any(r[0] == 1 and r[1] is None for r in got)
