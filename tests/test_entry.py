"""The entry module without the optional operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
sys.modules[{name!r}] = None      # every import of it raises ImportError
import __spark_entry__ as E
names = set(E.queries())
assert "mart_summary" in names and set(E.oracle_sql()) <= names, names
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
"""


def _runs_without(name):
    r = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True)
    assert r.returncode == 0, r.stderr


def test_entry_without_a_library_of_the_operators():
    _runs_without("xxhash")


def test_entry_without_the_subpackage():
    _runs_without("carelens.llm")
