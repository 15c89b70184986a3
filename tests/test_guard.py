"""The engine works without the training-data operators, which nothing of it imports."""

import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_core_imports_no_llm():
    for path in (ROOT / "clauselake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in "".join(line for line in path.read_text().splitlines() if "import" in line), path


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "clauselake", tmp_path / "clauselake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, has_ops, known = run.stdout.split()
    assert int(n) > 50 and has_ops == "False" and known == "True"


def test_entry_with_a_missing_dependency(tmp_path):
    """A package that the training-data operators import may be missing: the core queries stay."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, check=True)
    n, has_ops, known = run.stdout.split()
    assert int(n) > 50 and has_ops == "False" and known == "True"
