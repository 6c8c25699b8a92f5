import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_imports_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "ledgerloom"):
        subprocess.run(["cp", "-r", REPO / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "ledgerloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'chain_derive' in q and not any(n.startswith('op') and n[2].isdigit() for n in q), q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
