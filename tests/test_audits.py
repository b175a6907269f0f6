"""audit_rules against its SQL on audits without a key or an order, and on means that differ from the baseline's by rounding alone."""

import math
import random

import duckdb

from plantlens.plans import queries as own


def test_audit_rules_equals_sql_to_the_sign_of_zero(spark, tmp_path):
    draw = random.Random(5)
    rows = [(k % 200, k // 200, draw.randint(1, 9)) for k in range(8000) for _ in range(3)]
    rows += [(None, k, 5) for k in range(30)] + [(k % 7, None, 20) for k in range(21)]
    spark.createDataFrame([(s, o, float(q)) for s, o, q in rows], "l_suppkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    signed = lambda records: sorted(((s, o, None if z is None else (z, math.copysign(1, z)), rules) for s, o, z, rules in records), key=repr)
    mine, theirs = signed(map(tuple, own.queries()["audit_rules"](spark, str(tmp_path)).collect())), signed(con.sql(own.oracle_sql()["audit_rules"]).fetchall())
    assert any(z == (0.0, -1.0) for _, _, z, _ in theirs) and any(o is None for _, o, _, _ in theirs)
    assert mine == theirs
