import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry_without_the_training_operators(tmp_path):
    """The rest must import with the subpackage and the pipeline gone."""
    for p in ("tidemark", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path / p)], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run(["rm", "-rf", str(tmp_path / "tidemark" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'e06_reach_depths' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["node", "depth", "dataset_urn"] and df.count() > 0
