"""The driver contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderdate", "o_orderpriority", "_rows_count", "o_totalprice_sum", "o_totalprice_avg"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left_behind", [False, True])
def test_imports_without_the_corpus_operators(tmp_path, left_behind):
    """In a copy that lacks them; a folder may be left behind with nothing but compiled files."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(here, "spindle"), tmp_path / "spindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left_behind:
        (tmp_path / "spindle" / "llm" / "__pycache__").mkdir(parents=True)
    code = (
        "import sys, __spark_entry__ as e; assert 'bucket_time' in e.queries() and not any(k.startswith('op') for k in e.queries())\n"
        "assert not any(m.startswith(('spindle.llm.', 'corpus_pipeline')) for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_other_import_errors_are_not_hidden(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(here, "spindle"), tmp_path / "spindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr
