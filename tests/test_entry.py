import os
import subprocess
import sys

from tests.conftest import ROOT


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_returnflag", "l_linestatus", "sum_qty", "avg_disc", "n"] and e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy without the corpus operators' folder and pipeline still imports, with its own queries."""
    import shutil

    shutil.copytree(ROOT / "spalt", tmp_path / "spalt", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_group' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 60, out.stderr


def test_nothing_else_imports_them():
    for p in (ROOT / "spalt").rglob("*.py"):
        if "llm" not in p.parts:
            assert "spalt.llm" not in p.read_text()
