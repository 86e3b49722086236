"""The driver contract holds with and without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from workload.queries import ORACLES, QUERIES


def test_all_library_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def run_entry(folder):
    """Names of queries and of reference SQL as a new process sees them in a copy of the repository."""
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [set(line.split()) for line in done.stdout.splitlines()]


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("talentweave/llm/__pycache__/queries.pyc",)])
def test_entry_without_the_corpus_operators(tmp_path, left):
    """With the package deleted the other queries remain, whether the pipeline's file or compiled remains are left or not."""
    root = os.path.dirname(entry.__file__)
    for name in ("talentweave", "workload"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    for name in left:
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        source = f"{root}/{name}"
        if os.path.exists(source):
            shutil.copy(source, tmp_path / name)
        else:
            (tmp_path / name).write_bytes(b"")
    assert run_entry(tmp_path) == [set(QUERIES), set(ORACLES)]
