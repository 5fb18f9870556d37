import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from corpusloom.plans import queries as plans
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_duckdb(name, spark, duck, small):
    got, want = plans.QUERIES[name](spark, small).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(name, spark, small):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_operators(tmp_path):
    """Deleted, emptied, or with a library missing: the entry loads, without their queries."""
    root = Path(__file__).resolve().parents[1]
    for case in ("deleted", "emptied", "broken"):
        folder = tmp_path / case
        shutil.copytree(root / "corpusloom", folder / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", folder)
        if (root / "corpus_pipeline.py").exists() and case != "deleted":
            shutil.copy(root / "corpus_pipeline.py", folder)
        if case != "deleted":
            (folder / "corpusloom" / "llm" / "__pycache__").mkdir(parents=True)
        if case == "broken":
            (folder / "corpusloom" / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
        subprocess.run([sys.executable, "-c", code], cwd=folder, check=True)
