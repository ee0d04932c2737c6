from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_needs_no_session_and_sql_names_queries():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()[-1]) > 50


def test_core_imports_without_llm():
    code = "import sys; sys.modules['attestry.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
