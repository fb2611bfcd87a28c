"""The library and the entry module stand without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "terradelta", tmp_path / "terradelta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_it():
    for f in (ROOT / "terradelta").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "terradelta.llm" not in f.read_text()
