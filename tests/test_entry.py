from __future__ import annotations

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_is_callable_and_sql_belongs_to_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert all(callable(f) for f in entry.queries().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "stripmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_entry_imports_without_them(tmp_path):
    (tmp_path / "stripmill").mkdir()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for path in (ROOT / "stripmill").rglob("*.py"):
        to = tmp_path / path.relative_to(ROOT)
        if "llm" not in to.relative_to(tmp_path).parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[-1] == "False", out.stderr
