import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from varloom.plans import catalog, catalog_sources

OWN = catalog.queries() | catalog_sources.queries()
SQL = catalog.oracle_sql() | catalog_sources.oracle_sql()

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _cell(v):
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = OWN[name](spark, SF)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted(tuple(map(_cell, r)) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(tuple(map(_cell, r)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert row["number_of_records"] == row["true_positives"] + row["false_positives"]
    assert row["total_truth_records"] == row["true_positives"] + row["false_negatives"]
    assert set(OWN) <= set(e.queries())


@pytest.mark.parametrize("with_pipeline, leftovers", [(True, False), (False, False), (True, True)])
def test_the_rest_works_without_the_text_operators(tmp_path, with_pipeline, leftovers):
    """A whole copy without the subpackage on training text and its tests, with and without the pipeline's file."""
    root, copy = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache"))
    if leftovers:
        (copy / "varloom" / "llm" / "__pycache__").mkdir(parents=True)
    pipeline = copy / "corpus_pipeline.py"
    if with_pipeline:
        pipeline.touch() if pipeline.exists() else pipeline.write_text("import varloom.llm.base\n")
    elif pipeline.exists():
        pipeline.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
