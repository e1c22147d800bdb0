"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_stream_query_has_sql():
    from streamloom import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql()) and len(catalog.queries()) > 75


def test_entry_without_the_optional_folders(tmp_path):
    shutil.copytree(f"{REPO}/streamloom", tmp_path / "streamloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    os.makedirs(tmp_path / "streamloom/llm/__pycache__")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == len(e.oracle_sql()) > 75 and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
