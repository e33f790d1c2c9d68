"""The driver's contract, and that the corpus subpackage can be missing."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_module


def test_contract(spark):
    assert entry_module.entry(spark).count() > 0
    found = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(found) and len(found) > 50


def test_without_the_corpus_subpackage(tmp_path):
    """The queries of a copy without the subpackage, and of one without the pipeline file too."""
    root = Path(entry_module.__file__).parent
    code = "import __spark_entry__ as e; q = e.queries(); assert 'monthly_overview' in q and set(e.oracle_sql()) <= set(q); assert not any(k[:2] == 'op' and k[2].isdigit() for k in q) and 'pipeline' not in q"
    shutil.copytree(root / "ledgerlake", tmp_path / "ledgerlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
