"""The entry module, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registered_queries_have_names_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_core_stands_alone(tmp_path):
    """Importing the core and the entry module works where the training-data operators are gone."""
    shutil.copytree(ROOT / "netlens", tmp_path / "netlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(x.startswith('op') for x in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
