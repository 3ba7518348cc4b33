"""The library works without the training-data subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_it(tmp_path):
    shutil.copytree(f"{ROOT}/timeloom", tmp_path / "timeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert out.returncode == 0, out.stderr


def test_the_rest_passes_without_it(tmp_path):
    """Tests of the library proper, in a copy without both folders and the pipeline."""
    for folder in ("timeloom", "tests"):
        shutil.copytree(f"{ROOT}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    names = ["tests/test_entry.py", "tests/test_sources.py", "tests/test_operators.py"]
    every = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert every.returncode == 0 and "test_queries" in every.stdout, every.stdout[-2000:]
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *names], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert out.returncode == 0, out.stdout[-2000:]


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/timeloom"):
        if "/llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                text = open(f"{folder}/{name}", encoding="utf-8").read()
                assert "timeloom.llm" not in text and "from .llm" not in text and "from ..llm" not in text
