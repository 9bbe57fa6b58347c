"""Queries against their SQL, and the guards around the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

from gridloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, same_rows):
    same_rows(registry.queries()[name], registry.oracle_sql()[name])


def test_all_ten_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == list(range(1, 11))


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).parents[2]
    for path in (root / "gridloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gridloom.llm" not in path.read_text(), path


def test_entry_works_without_the_subpackage(tmp_path):
    root = Path(__file__).parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
import importlib.abc
import importlib.util as util
find = util.find_spec
util.find_spec = lambda name, *a: None if name in ("gridloom.llm", "corpus_pipeline") else find(name, *a)
import __spark_entry__ as e
assert e.queries() and not any(q.startswith("op1") or q == "pipeline" for q in e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
