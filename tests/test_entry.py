import importlib
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["part"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_optional_parts(tmp_path):
    for p in ("__spark_entry__.py", "quern"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "quern" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hop_distinct_targets' in q and not any(k.startswith('op') for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_every_query_against_duckdb(spark):
    """A sample of the registered SQL at the smallest size; the whole is compared at sf 0.01 outside the tests."""
    import duckdb

    catalogue = importlib.import_module("quern.plans.catalogue")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("hop_distinct_targets", "before_first_mention", "sequence_prev_k", "merge_nodes", "schema_validate_flip", "json_props"):
        df = catalogue.QUERIES[name](spark, sf)
        want = con.sql(catalogue.SQL[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        a = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
        at = [want.columns.index(c) for c in cols]
        assert a == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall()))), name
