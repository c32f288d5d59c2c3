"""The entry module: its queries, and that it works without the training-data operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_have_names_and_sql():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert len(queries) > 120 and set(sql) <= set(queries) and all(map(callable, queries.values()))


def test_entry_works_without_the_operators(tmp_path):
    shutil.copytree(f"{HERE}/axisweave", f"{tmp_path}/axisweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dot' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=100)


def test_results_match_the_sql(spark):
    """A few queries of each family against DuckDB, as the driver compares them."""
    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    queries, sql = e.queries(), e.oracle_sql()
    for name in ("occurrence", "pivot_std", "without_zeros", "add", "divide", "mask_dot", "row_min", "truncate_chain", "similarity_users", "round_robin", "anomaly", "index_lookup", "stream_occurrence"):
        got = queries[name](spark, d)
        want = con.sql(f"select {', '.join(got.columns)} from ({sql[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
